"""The queries of the text operators, and the SQL that those equal which SQL can express."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: the permutation deals row numbers, so counts differ by one at most."""
    from tidyward.llm.sharding import shard_rows
    return shard_rows(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row")


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyward.llm.exact import exact_groups
    return exact_groups(table(spark, sf_dir, "documents"))


EXPECTED["op2_exact_dedup"] = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyward.llm.bytepair import encode_texts
    coded = encode_texts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyward.llm.counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyward.llm.packing import pack_tokens
    return pack_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyward.llm.near import near_groups
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence goes here, the first as well; bytes, not characters, count."""
    from tidyward.llm.repeats import drop_repeats
    cut = drop_repeats(table(spark, sf_dir, "documents"), keep_first=False, whole_characters=False)
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyward.llm.quality import score_quality
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


@query
def op5_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyward.llm.lines import drop_templates
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_templates(docs, whole_lines=True).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


EXPECTED["op5_log_templates"] = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS whole,
    unnest(range(len(string_split(text, chr(10))))) AS nr
  FROM documents),
tokens AS (
  SELECT doc_id, text, whole, nr, list_transform(
      string_split(trim(regexp_replace(whole, '[ \t\r\f\v]+', ' ', 'g')), ' '),
      lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS parts
  FROM lines),
long AS (
  SELECT doc_id, text, nr, parts, array_to_string(parts[1:3], ' ') AS head, len(parts) AS n
  FROM tokens WHERE len(parts) >= 3),
leaves AS (
  SELECT n, head FROM long GROUP BY n, head HAVING count(DISTINCT text) >= 10),
near AS (SELECT long.* FROM long JOIN leaves USING (n, head)),
kinds AS (SELECT n, head, parts, count(DISTINCT text) AS texts FROM near GROUP BY n, head, parts),
spread AS (SELECT n, head, parts, texts, unnest(parts) AS token, unnest(range(n)) AS nr FROM kinds),
constant AS (
  SELECT n, head, nr, token FROM spread WHERE token <> '<*>'
  GROUP BY n, head, nr, token HAVING sum(texts) >= 10),
templates AS (
  SELECT s.n, s.parts, count(c.token) AS fixed,
    string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY s.nr) AS template
  FROM spread s LEFT JOIN constant c ON c.n = s.n AND c.head = s.head AND c.nr = s.nr AND c.token = s.token
  GROUP BY s.n, s.parts HAVING count(c.token) >= s.n * 0.6),
placed AS (SELECT doc_id, text, near.nr, template FROM near JOIN templates USING (n, parts)),
recurring AS (SELECT template FROM placed GROUP BY template HAVING count(DISTINCT text) >= 10),
same AS (
  SELECT doc_id, text, nr, regexp_replace(whole, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g') AS line FROM lines),
often AS (SELECT line FROM same WHERE line <> '' GROUP BY line HAVING count(DISTINCT text) >= 10),
gone AS (
  SELECT doc_id, nr FROM placed JOIN recurring USING (template)
  UNION SELECT doc_id, nr FROM same JOIN often USING (line))
SELECT l.doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(g.nr) AS INT) AS n_dropped,
  sha256(coalesce(string_agg(l.whole, chr(10) ORDER BY l.nr) FILTER (g.nr IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.nr = l.nr
GROUP BY l.doc_id
"""


@query
def op4_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyward.llm.neighbours import nearest
    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op11_pstable_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyward.llm.pstable import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs of a label. Hashing misses a pair at the threshold once in 10,000.
EXPECTED["op11_pstable_links"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.98 * sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lows AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN lows l ON l.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""


@query
def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidyward.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document by crc32 of its id is read with A-Z of its text lower-cased and checked
    against the proof of the text as it is."""
    from tidyward.llm.manifest import folded, leaf_digest, merkle_manifest, proof_text
    fields = ("doc_id", "source", "lang", "n_chars")
    tampered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_digest(*map(F.col, fields), tampered))
    made = merkle_manifest(table(spark, sf_dir, "documents"), carry={"seen": seen})
    return made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("siblings")), 256).alias("proof_sha256"),
        folded(F.coalesce("seen", "leaf"), F.col("siblings")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _merkle_sql(levels: int = 6) -> str:
    """Window functions over each level in turn; enough levels for 16 ** 6 rows a source."""
    def value(c):
        return (f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' "
                f"|| CAST({c} AS VARCHAR) END")

    head = " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 bit by bit, as DuckDB has no such function
    parts = [f"""d AS (
  SELECT doc_id, source, sha256({head} || {value('text')}) AS leaf, sha256({head} || {value(low)}) AS lowered,
    CAST(doc_id AS VARCHAR) AS name FROM documents),
docs AS (
  SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''),
      lambda ch: ascii(ch)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b),
      [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 5 = 0
    THEN lowered ELSE leaf END AS seen,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nr,
    count(*) OVER (PARTITION BY source) AS n
  FROM d)"""]

    def climb(name, key, start):
        parts.append(f"{name}0 AS ({start})")
        for k in range(levels):
            parts.append(f"""{name}{k}s AS (
  SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), '') END AS before, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER (w ROWS
      BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS after
  FROM {name}{k} WINDOW w AS (PARTITION BY {key}, nr // 16 ORDER BY nr))""")
            parts.append(f"""{name}{k + 1} AS (
  SELECT {key}, nr // 16 AS nr, CASE WHEN n = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY nr)) END
    AS digest, (n + 15) // 16 AS n FROM {name}{k} GROUP BY {key}, nr // 16, n)""")

    climb("g", "source", "SELECT source, nr, leaf AS digest, n FROM docs")
    climb("r", "one", f"""SELECT 1 AS one, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS nr, digest,
  count(*) OVER () AS n FROM g{levels}""")
    parts.append("fold0 AS (SELECT doc_id, source, leaf, nr, 0 AS up, seen AS node, '' AS proof FROM docs)")
    step = 0
    for name in ("g", "r"):
        for k in range(levels):
            if name == "r" and k == 0:
                parts.append(f"fold{step}u AS (SELECT f.* REPLACE (s.nr AS nr) FROM fold{step} f JOIN r0 s "
                             "ON s.source IS NOT DISTINCT FROM f.source)")
            was = f"fold{step}u" if name == "r" and k == 0 else f"fold{step}"
            same = "s.source IS NOT DISTINCT FROM f.source AND " if name == "g" else ""
            parts.append(f"""fold{step + 1} AS (
  SELECT f.* REPLACE (f.nr // 16 AS nr, CASE WHEN s.n = 1 THEN node ELSE sha256(before || node || after) END AS node,
    CASE WHEN s.n = 1 THEN proof ELSE proof || before || after END AS proof)
  FROM {was} f JOIN {name}{k}s s ON {same}s.nr = f.nr)""")
            step += 1
    return ("WITH " + ",\n".join(parts) + f"""
SELECT f.doc_id, f.leaf, g.digest AS subroot, r.digest AS root, sha256(f.proof) AS proof_sha256,
  f.node AS folded_root, f.node = r.digest AS verified
FROM fold{step} f JOIN g{levels} g ON g.source IS NOT DISTINCT FROM f.source, r{levels} r""")


EXPECTED["op13_merkle_manifest"] = _merkle_sql()
