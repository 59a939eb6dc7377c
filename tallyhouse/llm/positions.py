"""Phrase and proximity search by a distributed positional inverted index; decontamination.

Postings (word, doc, pos) are stored on shared storage for the words that are looked up. A phrase starts
from the postings of its rarest word; each further word, in order of rarity, keeps the starts that its
own postings, moved back by the word's offset, contain as well (proximity: within ``slack`` of it).
For decontamination the three rarest words of a window are looked up and the few starts that are left
are compared with the text word by word. All of it is DataFrame functions.

Documents are known by a row number, so repeated and null doc_ids stay apart. It is given once and stored
with the text (``shared.numbered``): all scans read the same numbers, however they are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.llm.shared import ROW, UPPER, bound, numbered, size_class, staged

#: ASCII characters that belong to no word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
BETWEEN = "".join(
    chr(c) for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
)
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    spaced = F.translate(
        F.coalesce(text, F.lit("")), BETWEEN + UPPER, " " * len(BETWEEN) + UPPER.lower()
    )
    return F.array_remove(F.split(spaced, " "), "")


def small(df: DataFrame) -> DataFrame:
    """``df`` (narrow, staged) with a broadcast hint if it is proven small."""
    return F.broadcast(df) if size_class(df, BROADCAST_ROWS) else df


def tokens(docs: DataFrame) -> DataFrame:
    """(doc, pos, word) of every word; ``docs`` has (``_row``, text)."""
    return docs.select(F.col(ROW).alias("doc"), F.posexplode(words(F.col("text"))).alias("pos", "word"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, n): occurrences of ``terms`` (word, distinct) in all documents."""
    found = docs.select(F.explode(words(F.col("text"))).alias("word"))
    few = size_class(terms, BROADCAST_ROWS)
    if few:
        found = found.join(F.broadcast(terms), "word", "left_semi")
    counts = found.groupBy("word").agg(F.count("*").alias("n"))
    return counts if few else counts.join(terms, "word", "left_semi")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: (word, doc, pos) of ``terms`` (word, distinct)."""
    return staged(tokens(docs).join(small(terms), "word", "left_semi"), "postings")


def phrases_of(items: DataFrame, length: int) -> DataFrame:
    """(item, window): each run of ``length`` words of an item (item_id, text), or the whole of a shorter
    one; items without words give none. Distinct; a null item_id counts as the empty string."""
    w = F.col("w")
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - length, F.lit(0))),
        lambda i: F.slice(w, i + 1, F.lit(length)),
    )
    return (
        items.select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
            words(F.col("text")).alias("w"),
        )
        .where(F.size("w") > 0)
        .select("item", F.explode(runs).alias("window"))
        .distinct()
    )


def with_keys(phrases: DataFrame, counts: DataFrame, most: int | None) -> DataFrame:
    """``phrases`` (phrase, window) with ``keys``: (n, offset, word), rarest first, at most ``most``.

    Phrases with a word that no document has are dropped: they cannot occur.
    """
    each = phrases.select("phrase", "window", F.posexplode("window").alias("offset", "word"))
    keyed = (
        each.join(counts, "word")
        .groupBy("phrase")
        .agg(
            F.any_value("window").alias("window"),
            F.array_sort(F.collect_list(F.struct("n", "offset", "word"))).alias("keys"),
        )
        .where(F.size("keys") == F.size("window"))
    )
    return keyed if most is None else keyed.withColumn("keys", F.slice("keys", 1, most))


def matches(index: DataFrame, phrases: DataFrame, n_keys: int, slack: int = 0) -> DataFrame:
    """(phrase, doc, start) where the first ``n_keys`` keys of a phrase stand at their offsets from
    ``start``, each but the rarest within ``slack`` words of it. ``phrases`` comes from
    ``with_keys``; shorter phrases use the keys they have. Distinct.
    """
    first = phrases.select(
        "phrase", "keys", F.col("keys")[0].word.alias("word"), F.col("keys")[0].offset.alias("offset")
    )
    found = (
        index.join(first, "word")
        .select("phrase", "keys", "doc", (F.col("pos") - F.col("offset")).alias("start"))
        .where(F.col("start") >= 0)
    )
    for k in range(1, n_keys):
        has = F.size("keys") > k
        key = F.get("keys", F.lit(k))
        at = F.col("start") + key.offset
        more = found.where(has).select(
            "phrase",
            "keys",
            "doc",
            "start",
            key.word.alias("word"),
            F.explode(F.sequence(at - slack, at + slack)).alias("pos"),
        )
        kept = more.join(index, ["word", "doc", "pos"]).select("phrase", "keys", "doc", "start")
        if slack:
            kept = kept.distinct()
        found = kept.unionByName(found.where(~has))
    return found.select("phrase", "doc", "start")


def occurrences(docs: DataFrame, found: DataFrame, phrases: DataFrame) -> DataFrame:
    """Of ``found`` (phrase, doc, start) those that the text bears out, a row a document:
    (doc, hits) with hits an array of (start, stop, phrase) in order."""
    each = (
        found.join(phrases.select("phrase", "window"), "phrase")
        .groupBy("doc")
        .agg(F.collect_set(F.struct("start", "window", "phrase")).alias("claims"))
    )
    each = staged(each, "claims")
    texts = docs.withColumnRenamed(ROW, "doc").join(
        F.broadcast(each.select("doc")) if size_class(each, BROADCAST_ROWS) else each.select("doc"),
        "doc",
        "left_semi",
    )
    true = bound(
        words(F.col("text")),
        lambda w: F.filter("claims", lambda c: F.slice(w, c.start + 1, F.size(c.window)) == c.window),
    )
    return (
        texts.join(each, "doc")
        .select(
            "doc",
            F.array_sort(
                F.transform(
                    true,
                    lambda c: F.struct(
                        c.start.alias("start"),
                        (c.start + F.size(c.window)).alias("stop"),
                        c.phrase.alias("phrase"),
                    ),
                )
            ).alias("hits"),
        )
        .where(F.size("hits") > 0)
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, length: int = 13, n_keys: int = 3, share: int = 20
) -> DataFrame:
    """For each row of ``docs`` (``_row``, stored with it, doc_id, text and any others, which are ignored): ``_row``, doc_id, n_words,
    n_hit (words in an occurrence of an item's window), n_items, items_sha256 and ``contaminated``
    (``n_hit`` > 0 and ``share`` * ``n_hit`` >= ``n_words``).

    Null, empty and wordless texts have no words and no hits; an empty ``items`` or item
    without words matches nothing; repeated items count once. Without items ``items_sha256`` is that of the empty string.
    """
    texts = docs.select(ROW, "text")
    pairs = staged(phrases_of(items, length), "windows")
    phrases = staged(
        pairs.select("window").distinct().withColumn("phrase", F.monotonically_increasing_id()),
        "phrases",
    )
    terms = staged(phrases.select(F.explode("window").alias("word")).distinct(), "terms")
    counts = staged(term_counts(texts, terms), "counts")
    keyed = staged(with_keys(phrases, counts, n_keys), "keys")
    looked_up = staged(
        keyed.select(F.explode("keys").alias("key")).select("key.word").distinct(), "terms"
    )
    index = postings(texts, looked_up)
    hits = staged(occurrences(texts, matches(index, keyed, n_keys), keyed), "hits")
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("until")),
        lambda s, h: F.struct(
            (s.n + F.greatest(h.stop - F.greatest(s.until, h.start), F.lit(0))).alias("n"),
            F.greatest(s.until, h.stop).alias("until"),
        ),
        lambda s: s.n,
    )
    named = (
        hits.select("doc", F.explode(F.array_distinct(F.col("hits.phrase"))).alias("phrase"))
        .join(phrases, "phrase")
        .join(pairs, "window")
        .groupBy("doc")
        .agg(F.array_sort(F.collect_set("item")).alias("names"))
    )
    facts = docs.select(ROW, "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit, n_items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.size(F.coalesce("names", F.array()))
    return (
        facts.join(
            hits.select(F.col("doc").alias(ROW), covered.alias("n_hit")), ROW, "left"
        )
        .join(named.withColumnRenamed("doc", ROW), ROW, "left")
        .select(
            ROW,
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            n_items.cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("names", F.array()), ","), 256).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        )
    )


def op8_positional_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return decontaminate(numbered(docs.select("doc_id", "text")), items).drop(ROW)
