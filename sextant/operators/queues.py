"""Review queues: questions from pages, and batches of a queue for labelling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators.retrieval import rrf
from sextant.operators.sampling import hash_sample, numbered_within


def question_queue(pages: DataFrame, seed: str, n: int, pattern: str = T.TROUBLE, least: int = 80, most: int = 2500, head: int = 200, decode: Callable[[Column], Column] | None = None) -> DataFrame:
    """pages: page_id, html. id, page_id, question, query of n pages, by hash, whose text is of fitting length and about
    trouble; the query is the question's first words. decode: see text.html_to_text."""
    rows = pages.select("page_id", T.html_to_text(F.col("html"), decode).alias("question"))
    fits = rows.where(F.length("question").between(least, most) & F.col("question").rlike(f"(?i){pattern}"))
    some = hash_sample(fits, "page_id", seed, n)
    return some.select(T.item_id(F.lit("so"), F.col("page_id").cast("string")).alias("id"), "page_id", "question", T.head_words(F.col("question"), head).alias("query"))


def labelling_batches(queue: DataFrame, order: list[Column], size: int, task: str) -> DataFrame:
    """queue: id, query, candidates (texts). file, items, body: the queue in batches of `size`, each item with its lettered
    candidates, as the text that a labeller gets."""
    item = F.concat(F.lit('<item id="'), "id", F.lit('">\n<query>'), "query", F.lit("</query>\n"), T.lettered(F.col("candidates")), F.lit("\n</item>"))
    rows = numbered_within(queue, [], order).select("pos", F.floor((F.col("pos") - 1) / size).alias("batch"), item.alias("item"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])
    found = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("items"), F.array_join(items, "\n\n").alias("body"))
    return found.select(F.format_string("%s-%02d.md", F.lit(task), (F.col("batch") + 1).cast("int")).alias("file"), "items", "body")


#: What the chunks that an item is about are called, by task and the column with their id; the head of a batch.
ABOUT = {"test_pairs": {"labeled_chunk": "chunk_id"}, "train_audit": {"chunk": "chunk_id"}, "negatives_audit": {"positive_chunk": "chunk_id", "negative_chunk": "negative_id"}, "so_questions": {}}
HEAD = "# Batch: task `{task}`, {number} of {total}, {items} items\n\nLabel every item below for the task **`{task}`**, following the instructions."


def rendered(queue: DataFrame, chunks: DataFrame, task: str) -> DataFrame:
    """Adds item: what a labeller sees of each row. queue: id (known once), query (question for so_questions), the ids of the
    chunks that the task is about (see ABOUT) and, if there, candidates (chunk_ids, of which 26 get a letter); chunks:
    chunk_id, passage. A chunk that isn't there is an error."""
    name = F.struct(F.lit(None).cast("string").alias("letter"), F.lit("").alias("tag"), F.lit("").alias("chunk_id"))
    about = [F.struct(F.lit(None).cast("string").alias("letter"), F.lit(tag).alias("tag"), F.col(c).alias("chunk_id")) for tag, c in ABOUT[task].items()]
    listed = F.array(*about) if about else F.slice(F.array(name), 1, 0)
    if "candidates" in queue.columns:
        some = F.slice(F.coalesce("candidates", F.array().cast("array<string>")), 1, len(T.LETTERS))
        listed = F.concat(listed, F.transform(some, lambda c, k: F.struct(F.char(k + 65).alias("letter"), F.lit("candidate").alias("tag"), c.alias("chunk_id"))))
    each = queue.select("id", F.posexplode(listed).alias("at", "x")).select("id", "at", "x.*").join(chunks.select("chunk_id", "passage"), "chunk_id", "left")
    attrs = F.concat(F.coalesce(F.concat(F.lit(' letter="'), "letter", F.lit('"')), F.lit("")), F.lit(' id="'), "chunk_id", F.lit('"'))
    missing = F.raise_error(F.concat(F.lit("no such chunk: "), "chunk_id")).cast("string")
    text = F.concat(F.lit("<"), "tag", attrs, F.lit(">\n"), F.coalesce("passage", missing), F.lit("\n</"), "tag", F.lit(">"))
    parts = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("text")))), lambda x: x["text"]).alias("_parts"))
    asked = F.concat(F.lit("<question>\n"), "question", F.lit("\n</question>")) if task == "so_questions" else F.concat(F.lit("<query>"), "query", F.lit("</query>"))
    lines = F.concat(F.array(F.concat(F.lit('<item id="'), "id", F.lit('">')), asked), F.coalesce("_parts", F.array().cast("array<string>")), F.array(F.lit("</item>")))
    return queue.join(parts, "id", "left").withColumn("item", F.array_join(lines, "\n")).drop("_parts")


def task_batches(queue: DataFrame, chunks: DataFrame, order: list[Column], size: int, task: str, prompt: str) -> DataFrame:
    """file, items, text: a queue (see rendered) in batches of `size`, each with the instructions, its head and its items."""
    rows = numbered_within(rendered(queue, chunks, task), [], order).select("pos", "n", F.floor((F.col("pos") - 1) / size).alias("batch"), "item")
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])
    found = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("items"), F.ceil(F.max("n") / size).alias("total"), F.array_join(items, "\n\n").alias("body"))
    head = T.filled(F.lit(HEAD), {"task": F.lit(task), "number": (F.col("batch") + 1).cast("string"), "total": F.col("total").cast("string"), "items": F.col("items").cast("string")})
    text = F.concat(F.lit(prompt.rstrip() + "\n\n---\n\n"), head, F.lit("\n\n"), "body", F.lit("\n"))
    return found.select(F.format_string("%s-%02d.md", F.lit(task), (F.col("batch") + 1).cast("int")).alias("file"), "items", text.alias("text"))


def with_candidates(questions: DataFrame, qid: str, rankings: list[DataFrame], k: int) -> DataFrame:
    """Adds candidates: the k documents that several rankings (qid, doc_id, rank) of the questions agree on, fused, in order."""
    best = rrf(rankings, k).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("candidates"))
    return questions.join(best.withColumnRenamed("qid", qid), qid, "left")


def cache_misses(rows: DataFrame, text: str, cache: DataFrame, model: str) -> DataFrame:
    """rows whose vectors the cache (key, vector) lacks, with the key: a hash of the model's name and the text."""
    keyed = rows.withColumn("key", F.sha2(F.concat(F.lit(model + "\n"), F.col(text)), 256))
    return keyed.join(cache.select("key"), "key", "left_anti")
