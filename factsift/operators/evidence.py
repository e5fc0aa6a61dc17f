"""Evidence resolution: claims x page store -> one evidence text per claim.

Plan shape (all DataFrame built-ins, no UDF):

1. ``evidence_refs``  - first evidence group only (P2), position-exploded (P3),
   usable references only (F1): ``(key, pos, title, idx)``.
2. distinct ``(title, idx)`` keys, grouped per title; one left join with the
   page store, so the store is read once and only cited pages are parsed.
3. the wanted lines of a page are picked on its own row with array functions
   (X1, X2, J2), the two kinds of miss told apart (J3, X3); references then
   join the resolved keys (J1).
4. ordered concat per claim (A1) and a left join back to the claims, so claims
   without groups or without usable references survive.

Scale notes: the page store is read once; a filter of fixed size (``title_filter``)
drops nearly all uncited pages in the scanning tasks, so the join and the
aggregate behind it move text in proportion to the cited titles, not to the
store. Every join is an equi join on a hash-partitioned key.
The resolved keys are written to the shared folder before the references
join them, so that join is planned from files: broadcast when the table is
small, otherwise a sort-merge join whose hot ``(title, idx)`` partition (one
page cited by a third of all claims) AQE splits across tasks. The per-claim
concat groups by ``claim_id``, whose groups are bounded by the length of one
evidence group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsift import constants as K
from factsift.functions.text import (page_line_parts, page_not_found,
                                     sentence_not_found, tolerant_int)
from factsift.session import shared_dir


ROW_HASH = "row_hash"
FILTER_BITS = 1 << 26  # of the title filter: at most FILTER_BITS / 64 rows of 16 bytes are broadcast


def row_hash(df: DataFrame) -> Column:
    """A key of a row's whole content, for inputs whose ids repeat or are missing."""
    return F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)


def has_groups(evidence: Column) -> Column:
    """True when the claim carries at least one evidence group."""
    return F.coalesce(F.size(evidence), F.lit(0)) > 0


def usable_ref(ref: Column) -> Column:
    """at least four positions and an integer at position 3."""
    return (F.coalesce(F.size(ref), F.lit(0)) >= 4) & tolerant_int(F.get(ref, 3)).isNotNull()


def evidence_refs(claims: DataFrame, group: int = 0, key: str = "claim_id",
                  evidence: str = "evidence") -> DataFrame:
    """P2 + P3 + F1: ``(claim_id, pos, title, idx)``, order and duplicates kept."""
    first = F.get(F.col(evidence), group)
    exploded = claims.select(key,
                             F.posexplode(first).alias("pos", "ref"))
    return (exploded.where(usable_ref(F.col("ref")))
            .select(key, "pos",
                    F.get(F.col("ref"), 2).alias("title"),
                    tolerant_int(F.get(F.col("ref"), 3)).alias("idx")))


def page_lines(pages: DataFrame) -> DataFrame:
    """X1 + X2: ``(id, ln, idx, sentence)`` for every line with a tab and an
    integer index."""
    lines = pages.select("id", F.posexplode(F.split(F.col("lines"), "\n")).alias("ln", "l"))
    idx_txt, sentence = page_line_parts(F.col("l"))
    return (lines.where(F.instr(F.col("l"), "\t") > 0)
            .select("id", "ln", tolerant_int(idx_txt).alias("idx"), sentence.alias("sentence"))
            .where(F.col("idx").isNotNull()))


def first_sentence(lines: DataFrame) -> DataFrame:
    """The first line per ``(id, idx)`` wins."""
    return (lines.groupBy("id", "idx")
            .agg(F.min_by(F.col("sentence"), F.col("ln")).alias("sentence")))


def page_sentences(pages: DataFrame) -> DataFrame:
    """X1 + X2 + J2 over a whole page store: ``(id, idx, sentence)``."""
    return first_sentence(page_lines(pages))


def title_filter(titles: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """A Bloom filter of one hash as a table: ``(word, mask)``, 64 bits a row.

    Its size is bounded by ``bits`` however many titles there are, so it can be
    broadcast; a page that no title cites passes with a chance of at most
    (titles / bits), a cited one always.
    """
    at = F.pmod(F.xxhash64("title"), F.lit(bits))
    return (titles.select(F.floor(at / 64).alias("word"), (at % 64).cast("int").alias("bit"))
            .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")))


def cited_pages(pages: DataFrame, titles: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The pages whose id passes the filter of ``titles``: no exchange of the store,
    and a bucketed store stays bucketed. NULL ids, which nothing cites, go."""
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    bit = F.col("mask").bitwiseAND(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(id), {bits}L) % 64 AS INT))"))
    found = (F.floor(at / 64) == F.col("word")) & (bit != 0)
    return pages.where(F.col("id").isNotNull()).join(F.broadcast(title_filter(titles, bits)), found, "left_semi")


def resolve_keys(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """Resolve distinct ``(title, idx)`` keys against the page store.

    The wanted indexes are grouped per title and stored first (they serve the
    filter of the store and the join), so the store is read once and joined
    once, pages that are not cited are dropped where they are read, and only
    cited pages are parsed. A page id that the store repeats counts with one of
    its rows (the least by its lines), picked after the join among cited pages
    only. Of lines with the same index the first one wins (J2).
    """
    wanted = _materialise(keys.groupBy("title").agg(F.collect_set("idx").alias("idxs")), "wanted-titles")
    store = cited_pages(pages, wanted).select(F.col("id").alias("found_id"), "lines")
    cited = (wanted.join(store, wanted["title"] == store["found_id"], "left")
             .groupBy("title").agg(F.first("idxs").alias("idxs"), F.min("lines").alias("lines"),
                                   F.max(F.col("found_id").isNotNull()).alias("found")))

    def parsed(line: Column) -> Column:
        idx, sentence = page_line_parts(line)
        return F.struct(F.when(F.instr(line, "\t") > 0, tolerant_int(idx)).alias("idx"), sentence.alias("sentence"))

    lines = F.transform(F.split(F.coalesce("lines", F.lit("")), "\n"), parsed)
    asked = cited.select("title", "found", "idxs", lines.alias("parsed")).select(
        "title", "found", "parsed", F.explode("idxs").alias("idx"))
    sentence = F.get(F.filter("parsed", lambda x: x["idx"] == F.col("idx")), 0)["sentence"]
    text = (F.when(~F.col("found"), page_not_found(F.col("title")))
            .when(F.col("sentence").isNull(), sentence_not_found(F.col("idx"), F.col("title")))
            .otherwise(F.col("sentence")))
    status = (F.when(~F.col("found"), F.lit(K.RES_PAGE_MISS))
              .when(F.col("sentence").isNull(), F.lit(K.RES_SENTENCE_MISS))
              .otherwise(F.lit(K.RES_RESOLVED)))
    return (asked.select("title", "found", "idx", sentence.alias("sentence"))
            .select("title", "idx", text.alias("sentence"), status.alias("status")))


def _materialise(df: DataFrame, name: str = "resolved-keys") -> DataFrame:
    """Write ``df`` as a table under the shared checkpoint folder and read it back.

    Used for the wanted titles and the resolved keys: read from files, the join back to the
    references gets a fresh exchange on both sides, so AQE can split a hot
    ``(title, idx)`` key (skew join needs shuffle stages on both sides, and an
    upstream hash partitioning would otherwise be reused), and the planner
    knows the table's size to broadcast it when it is small.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def resolve_refs(refs: DataFrame, pages: DataFrame, key: str = "claim_id") -> DataFrame:
    """J1-J3 per reference: ``(key, pos, sentence, status)``.

    Each distinct ``(title, idx)`` is resolved once; the references then join
    the resolved keys, which are materialised first (see ``_materialise``) so
    that a key cited by a third of all references is split across tasks. A NULL
    title matches no page, so such references go around the join.
    """
    named = refs.where(F.col("title").isNotNull())
    resolved = _materialise(resolve_keys(named.select("title", "idx").distinct(), pages))
    resolved = resolved.withColumnsRenamed({"title": "r_title", "idx": "r_idx"})
    joined = named.join(resolved, (named["title"] == resolved["r_title"]) & (named["idx"] == resolved["r_idx"]))
    unnamed = refs.where(F.col("title").isNull()).select(
        key, "pos", page_not_found(F.lit(None).cast("string")).alias("sentence"), F.lit(K.RES_PAGE_MISS).alias("status"))
    return joined.select(key, "pos", "sentence", "status").unionByName(unnamed)


def concat_evidence(resolved: DataFrame, key: str = "claim_id") -> DataFrame:
    """A1: ordered single-space concat per claim plus the worst outcome."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col("sentence"))))
    n_page = F.sum(F.when(F.col("status") == K.RES_PAGE_MISS, 1).otherwise(0))
    n_sent = F.sum(F.when(F.col("status") == K.RES_SENTENCE_MISS, 1).otherwise(0))
    return (resolved.groupBy(key)
            .agg(F.array_join(F.transform(ordered, lambda x: x["sentence"]), " ").alias("evidence_text"),
                 n_page.alias("n_page_miss"), n_sent.alias("n_sentence_miss")))


def resolve_evidence(claims: DataFrame, pages: DataFrame, group: int = 0,
                     keep: list[str] | None = None, key: str = "claim_id") -> DataFrame:
    """Q1: claims with an ``evidence`` text and a ``resolution`` status.

    ``claims`` needs ``key`` and ``evidence ARRAY<ARRAY<ARRAY<STRING>>>``;
    ``pages`` needs ``id`` and ``lines``. Columns in ``keep`` are carried over.
    ``key`` identifies a row; rows that share a key must be equal rows (a hash
    of the row is such a key, the reader's file-order ``seq`` another).
    """
    keep = keep if keep is not None else [c for c in ("claim", "label") if c in claims.columns]
    refs = evidence_refs(claims.dropDuplicates([key]) if key == ROW_HASH else claims, group, key)
    per_claim = concat_evidence(resolve_refs(refs, pages, key), key)
    base = claims.select(key, *keep, has_groups(F.col("evidence")).alias("_has_groups"))
    j = base.join(per_claim, key, "left")
    evidence = (F.when(~F.col("_has_groups"), F.lit(K.NO_EVIDENCE))
                .otherwise(F.coalesce(F.col("evidence_text"), F.lit(""))))
    resolution = (F.when(~F.col("_has_groups"), F.lit(K.RES_NO_EVIDENCE))
                  .when(F.col("evidence_text").isNull(), F.lit(K.RES_NO_USABLE))
                  .when(F.col("n_page_miss") > 0, F.lit(K.RES_PAGE_MISS))
                  .when(F.col("n_sentence_miss") > 0, F.lit(K.RES_SENTENCE_MISS))
                  .otherwise(F.lit(K.RES_RESOLVED)))
    return j.select(key, *keep, evidence.alias("evidence"), resolution.alias("resolution"))
