"""The queries op11 to op13 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .centroids import cluster_vectors
from .common import table
from .conversation_repair import repaired
from .merkle import PIECES, document_fingerprints


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


def _op11_sql() -> str:
    """A recursion over the rows of each conversation; per state the least (cost, audit) as a text whose order is that of the pair, with what has been written."""
    less = lambda *xs: f"list_sort(list_filter([{', '.join(xs)}], lambda x: x.k IS NOT NULL))[1]"
    edge = lambda s, cost, letter, said: f"{{'k': lpad(CAST(CAST(left({s}.k, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({s}.k, 13) || '{letter}', 'w': {said}}}"
    line = lambda s, role, text: f"({s}.w || (CASE WHEN {s}.w = '' THEN '' ELSE chr(10) END) || {role} || ':' || {text})"
    none = "CAST(NULL AS STRUCT(k VARCHAR, w VARCHAR))"
    gone = lambda s: edge(s, 2, "D", f"{s}.w")
    free = "fault IN (1, 2)"
    more = "(CASE WHEN fault = 3 THEN 5 ELSE 0 END)"
    rerole = lambda s, role: f"CASE WHEN {free} THEN {none} ELSE {edge(s, f'1 + {more}', 'R', line(s, chr(39) + role + chr(39), 'text'))} END"
    keep = lambda s, i: f"CASE WHEN {free} OR left(role, 1) <> '{i}' THEN {none} ELSE {edge(s, more, 'K', line(s, 'role', 'text'))} END"
    insert = lambda s, role: edge(s, 5, "I", line(s, f"'{role}'", "''"))
    two = less(gone("s2"), *[x for s in ("s0", "s1", "s3") for x in (rerole(s, "user"), keep(s, "u"))])
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) r(i)
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(z) + 1), lambda i: CAST(ascii(z[i]) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS z FROM conversations), crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS rn,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS said,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) || left(role, 1) AS pair
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN said > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault
  FROM ordered
), begin AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS rn, {{'k': '000000000000', 'w': ''}} AS s0, {none} AS s1,
         {{'k': '000000000005I', 'w': 'user:'}} AS s2, {{'k': '000000000010II', 'w': 'user:' || chr(10) || 'assistant:'}} AS s3
  FROM conversations
), walk AS (
  SELECT * FROM begin
  UNION ALL
  SELECT conv_id, rn, s0, s1, t2, {less("s3", insert("t2", "assistant"))} AS s3
  FROM (SELECT conv_id, rn, s0, s1, s3, {less("s2", insert("s0", "user"), insert("s1", "user"), insert("s3", "user"))} AS t2
        FROM (SELECT w.conv_id, f.rn, {gone("s0")} AS s0, {less(gone("s1"), keep("s0", "s"))} AS s1, {two} AS s2,
                     {less(gone("s3"), rerole("s2", "assistant"), keep("s2", "a"))} AS s3
              FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.rn = w.rn + 1))
), facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), ended AS (
  SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
         coalesce(illegal, 0) AS illegal, {less("w.s0", "w.s3")} AS best
  FROM begin b LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id
  JOIN walk w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.rn = coalesce(f.n, 0)
)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, CAST(left(best.k, 12) AS BIGINT) AS cost, substr(best.k, 13) AS audit, sha256(best.w) AS repaired_sha256
FROM ended
"""


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    """One step for each round; a centroid is a list of integers."""
    assign = lambda c: f"""
  SELECT vec_id, v, (list_sort(list({{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'cluster': i}}))[1]) AS near
  FROM kept, {c} GROUP BY rowid, vec_id, v"""  # noqa: E731
    parts = [
        f"""
WITH ints AS (SELECT row_number() OVER () AS rowid, vec_id, list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) END) AS v FROM embeddings WHERE len(embedding) = 64),
kept AS MATERIALIZED (SELECT * FROM ints WHERE len(list_filter(v, lambda x: x IS NULL)) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS i, v AS c FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))"""
    ]
    for r in range(1, rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED ({assign(f'c{r - 1}')}),
m{r} AS (SELECT i, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY p) AS c
         FROM (SELECT near.cluster AS i, p, sum(v[p]) AS s, count(*) AS n FROM a{r}, range(1, 65) q(p) GROUP BY ALL) GROUP BY i),
c{r} AS MATERIALIZED (SELECT o.i, coalesce(m.c, o.c) AS c FROM c{r - 1} o LEFT JOIN m{r} m ON m.i = o.i)"""
        )
    return (
        ",\n".join(parts)
        + f""", last AS MATERIALIZED ({assign(f'c{rounds}')})
SELECT vec_id, CAST(near.cluster AS INTEGER) AS cluster, CAST(near.d AS BIGINT) AS distance, CAST(sum(near.d) OVER (PARTITION BY near.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(c.c, 'string_agg', ',')) AS centroid_sha256
FROM last JOIN c{rounds} c ON c.i = near.cluster
"""
    )


def _op13_sql() -> str:
    pieces = lambda p: f"list_transform(regexp_extract_all({p}, '{PIECES}'), lambda x: sha256(x))"
    branch = lambda t: f"sha256(coalesce(list_aggregate({t}, 'string_agg', ','), ''))"
    text = lambda t, sep: f"coalesce(list_aggregate({t}, 'string_agg', '{sep}'), '')"
    leaves = lambda t: f"list_transform(string_split({t}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: {pieces('p')}))"
    root = lambda t: branch(f"list_transform({t}, lambda s: {branch('list_transform(s, lambda p: ' + branch('p') + ')')})")
    short = text("list_transform(p, lambda d: left(d, 8))", ",")
    tree = lambda t: text(f"list_transform({t}, lambda s: {text('list_transform(s, lambda p: ' + short + ')', ';')})", "|")
    dice = lambda a, b: f"CASE WHEN left({a}, 64) = left({b}, 64) THEN 1.0 ELSE 2.0 * len(list_intersect({set_of(a)}, {set_of(b)})) / (len({set_of(a)}) + len({set_of(b)})) END"
    set_of = lambda f: f"list_distinct(string_split(translate(substr({f}, 66), '|;', ',,'), ','))"
    sides = lambda t, sep: f"(CASE WHEN back THEN list_reverse(string_split({t}, '{sep}')) ELSE string_split({t}, '{sep}') END)"
    at = "list_position(list_transform(list_zip(x, y), lambda p: p[1] IS NOT DISTINCT FROM p[2]), false)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
leaves AS MATERIALIZED (SELECT doc_id, text, length(text) AS n, {leaves('text')} AS t FROM d),
f AS MATERIALIZED (SELECT doc_id, text, n, {root('t')} || ':' || {tree('t')} AS fingerprint FROM leaves),
linked AS MATERIALIZED (
  SELECT doc_id, n, text, fingerprint, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, coalesce(lead(fingerprint) OVER w, first_value(fingerprint) OVER w) AS next_fingerprint
  FROM f WINDOW w AS (ORDER BY doc_id DESC)),
edited AS MATERIALIZED (SELECT *, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM linked),
leaves2 AS MATERIALIZED (SELECT *, {leaves('edited')} AS t FROM edited),
both_sides AS MATERIALIZED (SELECT doc_id, n, sha256(edited) AS edited_sha256, fingerprint, next_fingerprint, {root('t')} || ':' || {tree('t')} AS edited_fingerprint FROM leaves2),
walks AS (SELECT doc_id, back, fingerprint AS o, edited_fingerprint AS e FROM both_sides, (VALUES (false), (true)) b(back) WHERE left(fingerprint, 64) <> left(edited_fingerprint, 64)),
level1 AS (SELECT *, {at} AS i FROM (SELECT doc_id, back, {sides('substr(o, 66)', '|')} AS x, {sides('substr(e, 66)', '|')} AS y FROM walks)),
level2 AS (SELECT *, {at} AS j FROM (SELECT doc_id, back, i, {sides('x[i]', ';')} AS x, {sides('y[i]', ';')} AS y FROM level1)),
level3 AS (SELECT *, {at} AS k FROM (SELECT doc_id, back, i, j, {sides('x[j]', ',')} AS x, {sides('y[j]', ',')} AS y FROM level2)),
paths AS (SELECT doc_id, back, concat_ws('.', i - 1, j - 1, k - 1) AS path FROM level3)
SELECT b.doc_id, n AS n_chars, edited_sha256, fingerprint, edited_fingerprint, CAST({dice('fingerprint', 'edited_fingerprint')} AS DOUBLE) AS near_edited,
       CAST({dice('fingerprint', 'next_fingerprint')} AS DOUBLE) AS near_next, p.path AS first_edit, q.path AS last_edit
FROM both_sides b LEFT JOIN paths p ON p.doc_id = b.doc_id AND NOT p.back LEFT JOIN paths q ON q.doc_id = b.doc_id AND q.back
"""


def queries() -> dict:
    return {"op11_conversation_repair": op11_conversation_repair, "op12_centroid_clusters": op12_centroid_clusters, "op13_merkle_fingerprints": op13_merkle_fingerprints}


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": _op11_sql(), "op12_centroid_clusters": _op12_sql(), "op13_merkle_fingerprints": _op13_sql()}
