"""Text columns: tokens, words, overlap, passages, ids and the small helpers of reports and prompts."""

from __future__ import annotations

import html.entities
import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, MapType, StringType, StructType

#: Words that carry no content.
STOPWORDS = "a an and are as at be but by can do does for from how i if in is it its my of on or our so that the their there this to was we what when where which why will with you your not no".split()
#: What marks a line of a log as an error, and a question as troubleshooting.
ERROR_LINE = r"error|fail|forbidden|denied|cannot|can't|not found|refused|timed out|timeout|exceeded|unknown|notready|pending|waiting|evict|oom|back-?off|unhealthy|invalid|unable|traceback|exception|panic|no such|permission"
TROUBLE = r"error|fail|crash|pending|not work|doesn'?t work|can'?t|cannot|unable|timeout|timed out|refused|backoff|oom|evict|forbidden|denied|stuck|restart|not found|unhealthy|probe"
#: Languages by file extension.
LANGUAGES = {".yaml": "yaml", ".yml": "yaml", ".json": "json", ".sh": "shell", ".conf": ""}
#: The front matter at the beginning of a Markdown file, as a pattern in which a dot is any character.
FRONT = r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"
#: Character references that any page has, that of the ampersand last.
COMMON = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&amp;", "&"))
#: Spaces of all kinds, those that SQL's trim takes off.
SPACES = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COMPOUND, WORD = "[a-z0-9]+(?:[._:/-][a-z0-9]+)*", "[a-z0-9]+"


def tokens(text: Column) -> Column:
    """Lower-cased words; identifiers such as a.b/c give their parts and then themselves."""
    found = F.regexp_extract_all(F.lower(text), F.lit(COMPOUND), F.lit(0))

    def parts(c: Column) -> Column:
        split = F.split(c, "[._:/-]")
        return F.when(F.size(split) > 1, F.concat(split, F.array(c))).otherwise(F.array(c))

    return F.flatten(F.transform(found, parts))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def normalized(text: Column) -> Column:
    """Words joined by spaces."""
    return F.array_join(words(text), " ")


def content_words(text: Column) -> Column:
    """Different words of two letters or more that are no stopwords."""
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS)))


def overlap(query: Column, passage: Column) -> Column:
    """Share of the query's content words that the passage has, both as arrays; 1 for a query without any."""
    return F.when(F.size(query) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(query, passage)) / F.size(query))


def one_line(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def passage(title: Column, section: Column, text: Column) -> Column:
    """Heading, an empty line, body."""
    head = F.when(section == "", title).otherwise(F.concat(title, F.lit(" > "), section))
    return F.concat(head, F.lit("\n\n"), text)


def section_label(path: Column, title: Column, depth: int = 2) -> Column:
    """The last headings of a trail that differ from the title, joined."""
    own = F.filter(path, lambda h: F.lower(h) != F.lower(title))
    return F.array_join(F.slice(own, F.greatest(F.lit(1), F.size(own) - depth + 1), F.lit(depth)), " > ")


def html_to_text(raw: Column, decode: Callable[[Column], Column] | None = None) -> Column:
    """Closing block tags and <br> end lines, other tags go; character references are decoded, as `unescaped` does unless said;
    lines lose trailing space, empty lines collapse."""
    text = F.regexp_replace(raw, r"(?i)</(p|pre|li|h\d)>|<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    text = F.regexp_replace((decode or unescaped)(text), r"[ \t]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def common_references(text: Column) -> Column:
    """The character references of COMMON decoded, in that order; all others stay, those without a semicolon too."""
    for name, char in COMMON:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often it is named: in functions of arrays nothing else is shared."""
    return F.get(F.transform(F.array(value), use), 0)


def unescaped(text: Column) -> Column:
    """Character references decoded as html.unescape does: all names that HTML knows, old ones without a semicolon too, and
    numbers, of which 128 to 159 are those of Windows; unknown ones stay. Text without an ampersand isn't touched, and
    names are looked up only where one stands."""
    names = F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")  # a constant, folded once
    old = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    windows = bytes(range(128, 160)).decode("cp1252", "replace")

    # what is no character goes
    gone = lambda c: c.between(1, 8) | c.between(14, 31) | c.isin(11, 127) | c.between(0xFDD0, 0xFDEF) | ((c % 0x10000 >= 0xFFFE) & (c <= 0x10FFFF))
    table = F.array(*[F.lit(chr(k + 128) if c == "\ufffd" else c) for k, c in enumerate(windows)])

    def number(code: Column) -> Column:
        usual = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.when(code.between(128, 159), F.get(table, code - 128)).when(gone(code), "").otherwise(usual)

    def numeric(name: Column) -> Column:
        digits = F.regexp_extract(name, r"^#[xX]?0*([0-9a-fA-F]*);?$", 1)
        code = _let(digits, lambda d: F.when(F.length(d) > 7, 0x110000).when(d == "", 0).when(name.rlike("^#[xX]"), F.conv(d, 16, 10).cast("int")).otherwise(d.try_cast("int")))
        return _let(code, number)

    def decoded(part: Column) -> Column:
        # what follows an ampersand: a reference up to its semicolon, then text
        full = F.regexp_extract(part, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)", 1)
        known = lambda x: (x != "") & (F.startswith(x, F.lit("#")) | F.try_element_at(names, x).isNotNull())
        name = _let(full, lambda x: F.when(known(x), x).otherwise(F.regexp_extract(part, "^(" + "|".join(old) + ")", 1)))

        def put(n: Column) -> Column:
            char = F.when(F.startswith(n, F.lit("#")), numeric(n)).otherwise(F.try_element_at(names, n))
            return F.when(n == "", F.concat(F.lit("&"), part)).otherwise(F.concat(char, F.substr(part, F.length(n) + 1)))

        return _let(name, put)

    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), decoded)
    return F.when(F.contains(text, F.lit("&")), F.concat(parts[0], F.array_join(rest, ""))).otherwise(text)


def doc_id(path: Column) -> Column:
    """A document's id from its path: no extension, no _index, no slash at the end."""
    return F.rtrim(F.regexp_replace(path, r"(/?_index)?\.md$", ""), F.lit("/"))


def slug(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-")


def last_part(name: Column) -> Column:
    """What follows the last slash, slashes at the end aside."""
    return F.element_at(F.split(F.rtrim(name, F.lit("/")), "/"), -1)


def code_fraction(text: Column) -> Column:
    """Share of characters inside closed code fences."""
    code = F.aggregate(F.regexp_extract_all(text, F.lit("(?s)```.*?```"), F.lit(0)), F.lit(0), lambda n, x: n + F.length(x))
    return code / F.greatest(F.length(text), F.lit(1))


def eligible(text: Column, most_code: float = 0.8, least_prose: int = 120) -> Column:
    """Enough prose outside fences, and not nearly all code."""
    prose = F.trim(F.regexp_replace(text, "(?s)```.*?```", ""), F.lit(" \t\n\r"))
    return (code_fraction(text) <= most_code) & (F.length(prose) >= least_prose)


def glob_pattern(glob: str) -> str:
    """A regular expression for a shell pattern, with *, ? and [sets], in which * crosses slashes."""
    parts, k = [], 0
    while k < len(glob):
        c, end = glob[k], glob.find("]", k + 2 + (glob[k + 1 : k + 2] == "!"))
        if c == "[" and end > 0:
            # a set of characters; ! at its beginning stands for all others
            inner = re.sub(r"([\\\[\]^&~|])", r"\\\1", glob[k + 1 : end].removeprefix("!"))
            parts.append(("[^" if glob[k + 1] == "!" else "[") + inner + "]")
            k = end
        else:
            parts.append({"*": ".*", "?": "."}.get(c) or ("\\" + c if not c.isalnum() and c not in "/_" else c))
        k += 1
    return "^" + "".join(parts) + "$"


def is_error_line(line: Column) -> Column:
    """Whether a trimmed line of a log looks like an error; a client's own complaints aren't the log's. As in SQL the long s and
    the sign of Kelvin are cases of s and k."""
    pattern = ERROR_LINE.replace("s", "[s\u017f]").replace("k", "[k\u212a]")
    return (line != "") & ~line.startswith("unable to retrieve") & ~line.startswith("Error from server") & line.rlike("(?i)" + pattern)


def all_error_lines(text: Column) -> Column:
    """The lines of a log that look like errors."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES))), is_error_line)


def error_lines(text: Column, last: int = 2) -> Column:
    """The last lines of a log that look like errors."""
    lines = all_error_lines(text)
    return F.slice(lines, F.greatest(F.lit(1), F.size(lines) - last + 1), F.lit(last))


def excluded(headings: Column, banned: list[str]) -> Column:
    """Whether one of a section's headings is banned, in any case."""
    return F.exists(headings, lambda h: F.lower(h).isin([b.lower() for b in banned]))


def head_words(text: Column, n: int) -> Column:
    """The first n words, joined by spaces."""
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def canonical_json(value: Column, kind: DataType) -> Column:
    """Compact JSON of a value of any kind, keys in order: what Python's json.dumps writes with sort_keys, without spaces and
    with characters beyond ASCII as they are. Null fields are null, dates and decimals are their texts."""
    if isinstance(kind, StructType):
        fields = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), canonical_json(value[f.name], f.dataType)) for f in sorted(kind, key=lambda f: f.name)]
        out = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        each = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(_quoted(k.cast("string")), F.lit(":"), canonical_json(F.element_at(value, k), kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}"))
    elif isinstance(kind, (DoubleType, FloatType)):
        out = _python_float(value.cast("double"))
    elif isinstance(kind, (BooleanType, IntegralType)):
        out = value.cast("string")
    else:
        out = _quoted(value.cast("string"))
    return F.coalesce(out, F.lit("null"))


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substr(listed, F.lit(2), F.length(listed) - 2))


def _python_float(x: Column) -> Column:
    """A double as Python writes it: plain from 1e-4 up to 1e16, else with an exponent of two digits at least."""
    text = x.cast("string")
    digits, power = F.regexp_replace(F.regexp_extract(text, r"^(-?[\d.]+)E", 1), r"\.0$", ""), F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    scientific = F.concat(digits, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    return F.when(~text.contains("E"), text).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain).otherwise(scientific)


def stable_hash(value: Column, kind: DataType | None = None) -> Column:
    """SHA-256 of a value as canonical JSON; without a kind, of an array of strings."""
    return F.sha2(canonical_json(value, kind or ArrayType(StringType())), 256)


def item_id(*parts: Column) -> Column:
    """The first 16 hex digits of the parts' stable hash."""
    return F.substring(stable_hash(F.array(*parts)), 1, 16)


def retry_seconds(message: Column) -> Column:
    """Seconds in "retry in 14h7m22.8s"; null where there are none."""
    pattern = r"(?i)retry in (?:(\d+)h)?(?:(\d+)m)?(?:([\d.]+)s)?"
    part = [F.regexp_extract(message, pattern, k) for k in (1, 2, 3)]
    total = F.lit(0.0)
    for p, unit in zip(part, (3600.0, 60.0, 1.0), strict=True):
        total = total + F.when(p == "", 0.0).otherwise(p.try_cast("double")) * unit
    return F.when(F.concat(*part) != "", total)


def unfenced(text: Column) -> Column:
    """JSON without one surrounding code fence."""
    return F.regexp_replace(text, r"(?s)\A\s*```(?:json)?\s*(.*?)\s*```\s*\z", "$1")


def fence_language(path: Column) -> Column:
    """The language of an inlined example by its extension, empty where unknown."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.regexp_extract(path, r"(\.[^./]+)$", 1)), F.lit(""))


def escape_dollars(text: Column) -> Column:
    return F.replace(text, F.lit("$"), F.lit("\\$"))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with {name} replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def _letter(x: Column) -> Column:
    """The place of a letter from 1, or 0 for what is no single letter."""
    c = F.upper(F.trim(x))
    return F.when(c.rlike("^[A-Z]$"), F.ascii(c) - 64).otherwise(0)


def letter_choices(letters: Column, candidates: Column) -> Column:
    """Candidates by letter, in order, once each; unknown letters are left out, see unknown_letters."""
    known = F.filter(letters, lambda x: _letter(x).between(1, F.size(candidates)))
    return F.array_distinct(F.transform(known, lambda x: F.element_at(candidates, _letter(x))))


def unknown_letters(letters: Column, candidates: Column) -> Column:
    """What of a list names no candidate."""
    return F.filter(letters, lambda x: ~F.coalesce(_letter(x).between(1, F.size(candidates)), F.lit(False)))


def lettered(candidates: Column) -> Column:
    """Lines of candidates with their letters."""
    return F.array_join(F.transform(candidates, lambda c, k: F.concat(F.lit('<candidate letter="'), F.char(k + 65), F.lit('">'), c, F.lit("</candidate>"))), "\n")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
