"""The queries of the problems for training data, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverfold.llm.components import group_rows
from silverfold.llm.mix import mix, shares
from silverfold.llm.subjects import assign_subjects, subject_mixtures
from silverfold.llm.survivor import current_values, learned, survivors
from silverfold.llm.tokens import encode
from silverfold.session import table

#: Usable times, fixed values.
USABLE_FROM, USABLE_TO = 946684800, 1798761599


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "phash_rows").select("file_id", "hash")
    pairs = table(spark, d, "phash_pairs").where("alike").select("hash_a", "hash_b")
    return group_rows(rows, pairs, "file_id", "hash", "hash_a", "hash_b")


P2_SQL = """
WITH RECURSIVE r AS (SELECT DISTINCT file_id, hash FROM phash_rows WHERE hash IS NOT NULL),
v AS (SELECT DISTINCT hash FROM r),
e AS (
  SELECT DISTINCT hash_a AS a, hash_b AS b FROM phash_pairs WHERE alike AND hash_a IN (FROM v) AND hash_b IN (FROM v)
), e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk AS (
  SELECT hash, hash AS far FROM v
  UNION
  SELECT w.hash, e2.b FROM walk w JOIN e2 ON e2.a = w.far
), low AS (SELECT hash, min(far) AS root FROM walk GROUP BY hash),
g AS (SELECT root, min(file_id) AS group_id FROM r JOIN low USING (hash) GROUP BY root HAVING count(DISTINCT file_id) > 1)
SELECT file_id, group_id FROM r JOIN low USING (hash) JOIN g USING (root)
"""


def usable_time(col: F.Column) -> F.Column:
    return F.when(col.between(USABLE_FROM, USABLE_TO), col)


#: The stated precedence of areas: a settled copy (area 1 or 2) is later than any other.
SETTLED_LATER = {"open": {"settled"}}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The stated precedence and criteria; rows of one file which these leave open follow the order of areas learned from the timed rows."""
    rows = table(spark, d, "member_rows")
    taken = usable_time(F.col("taken_at"))
    state = F.when(F.col("area").isin(1, 2), "settled").otherwise("open")
    # a bitwise not turns the order of sizes round without an overflow
    order = [F.col("size").isNull(), F.coalesce(F.bitwise_not("size"), F.lit(0).cast("long")), F.coalesce(taken, F.lit(USABLE_TO + 1).cast("long"))]
    areas = learned(rows, "group_id", "area", taken)
    got = survivors(
        rows, "group_id", "file_id", order, {"taken_at": taken, "width": F.col("width")}, state=state, later=SETTLED_LATER,
        value=None if areas is None else F.col("area"), value_later=areas or {},
    )
    return got.select("group_id", "file_id", *(F.coalesce(F.col(c), F.lit(-1).cast("long")).alias(c) for c in ("taken_at", "width")))


P5_SQL = """
WITH r AS (
  SELECT DISTINCT group_id, file_id, CASE WHEN area IN (1, 2) THEN 0 ELSE 1 END AS a, size, width,
    CASE WHEN taken_at BETWEEN 946684800 AND 1798761599 THEN taken_at END AS t FROM member_rows
), k AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY a, size DESC, t NULLS LAST, file_id) AS n FROM r
)
SELECT group_id, max(CASE WHEN n = 1 THEN file_id END) AS file_id, coalesce(arg_min(t, n), -1) AS taken_at, coalesce(arg_min(width, n), -1) AS width
FROM k GROUP BY group_id HAVING count(DISTINCT file_id) > 1
"""


def p5_current(spark: SparkSession, d: str) -> DataFrame:
    """The current area of each group, learned from the timed rows where times are missing."""
    rows = table(spark, d, "member_rows").select("group_id", "file_id", "area", "taken_at").distinct()
    return current_values(rows, "group_id", "area", usable_time(F.col("taken_at")))


P5_CURRENT_SQL = """
WITH RECURSIVE m AS (SELECT DISTINCT group_id AS g, file_id, CAST(area AS VARCHAR) AS v, CASE WHEN taken_at BETWEEN 946684800 AND 1798761599 THEN taken_at END AS t FROM member_rows),
r AS (SELECT * FROM m WHERE g IS NOT NULL AND v IS NOT NULL),
f AS (
  SELECT a.v, b.v AS w, count(*) AS n FROM (SELECT g, v, max(t) AS hi FROM r WHERE t IS NOT NULL GROUP BY g, v) a
  JOIN (SELECT g, v, min(t) AS lo FROM r WHERE t IS NOT NULL GROUP BY g, v) b ON a.g = b.g AND a.v <> b.v AND a.hi < b.lo GROUP BY a.v, b.v
), step AS (SELECT x.v, x.w, x.n - coalesce(y.n, 0) AS s FROM f x LEFT JOIN f y ON y.v = x.w AND y.w = x.v WHERE x.n > coalesce(y.n, 0)),
way AS (SELECT v, w, s FROM step UNION SELECT way.v, step.w, least(way.s, step.s) FROM way JOIN step ON step.v = way.w),
best AS (SELECT v, w, max(s) AS s FROM way GROUP BY v, w),
later AS (SELECT x.v, x.w FROM best x LEFT JOIN best y ON y.v = x.w AND y.w = x.v WHERE x.s > coalesce(y.s, 0)),
p AS (SELECT g, v, max(t) AS t, count(*) AS n FROM r GROUP BY g, v),
k AS (SELECT p.*, (SELECT count(*) FROM later JOIN p q ON q.v = later.w WHERE later.v = p.v AND q.g = p.g) AS above FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t DESC NULLS LAST, CASE WHEN t IS NULL THEN above ELSE 0 END, CASE WHEN t IS NULL THEN -n ELSE above END, v DESC) AS i FROM k)
SELECT g AS group_id, v AS value, CASE WHEN t IS NULL THEN 'learned' ELSE 'timed' END AS how FROM o WHERE i = 1
"""


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The largest mix in which every source of mix_targets that has documents gets its share."""
    docs = table(spark, d, "documents")
    sized = encode(docs.where("source is not null").withColumn("key", F.struct("doc_id", "source")), "key", "text", counts=True)
    return mix(sized.select("key.doc_id", "key.source", "n_tokens"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares the mix reached, by source."""
    return shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return assign_subjects(*(table(spark, d, t) for t in ("documents", "subject_labels", "subjects")))


def p9_mixtures(spark: SparkSession, d: str) -> DataFrame:
    """The corpus composition behind p9_found: each document's weight in each subject."""
    return subject_mixtures(*(table(spark, d, t) for t in ("documents", "subject_labels", "subjects")))


QUERIES = {
    "p2_found": p2_found,
    "p5_found": p5_found,
    "p5_current": p5_current,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_mixtures": p9_mixtures,
}

SQL = {
    "p2_found": P2_SQL,
    "p5_found": P5_SQL,
    "p5_current": P5_CURRENT_SQL,
}
