"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import (embedding_dedup, language_id, line_dedup, mixing, ngram_jaccard, periodic_runs, quality, secret_scan, sentencepiece_fst, sharding,
                           spelling_variants, vector_search, warc)
from meterlake.llm.texts import held_out
from meterlake.storage import Scratch


#: Words are anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 3, 1))
    model = language_id.train(docs.filter(~F.col("held_out")))
    return language_id.identify(docs, model, ["doc_id", "held_out"])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    pages = warc.with_revisits(_table(spark, sf_dir, "pages"))
    index = scratch.store(warc.write(pages, scratch.path("archive")), "index")
    records = warc.read(index, warc.read_tasks(index), payloads=False)
    return scratch.release(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(_table(spark, sf_dir, "documents"), ["doc_id"])


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similar_groups(_table(spark, sf_dir, "documents"), ngram_jaccard.Rule(3, 90))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 4, 2))
    labels = _table(spark, sf_dir, "labels").filter(~held_out("doc_id", 4, 2))
    return quality.score(docs, quality.train(docs, labels), ["doc_id", "held_out"])


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(docs), ["doc_id"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), ["doc_id"])


def planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in the texts that the contract names, words from the a-th on repeat with period p."""
    hashed = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    words = hashed.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    placed = words.withColumn("a", F.expr("(h div 10) % nullif(size(w), 0)")).withColumn("p", F.expr("1 + (size(w) - a) div (3 + (h div 10) % 8)"))
    repeated = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)])), ' ')")
    return placed.select("doc_id", F.when(F.size("w") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_repeats(_table(spark, sf_dir, "documents")), ["doc_id"])
    # Runs come by start, then period, so a later run must have a strictly greater length / period.
    top = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return (found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(_table(spark, sf_dir, "documents"), typos_one_in=97)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "lines")
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"), ["doc_id"], scratch)
    return scratch.release(kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")))


QUERIES = {
    "op1_language_id": op1_language_id, "op2_sharding": op2_sharding, "op3_warc": op3_warc,
    "op4_sentencepiece": op4_sentencepiece, "op5_embedding_dedup": op5_embedding_dedup, "op6_ngram_jaccard": op6_ngram_jaccard, "op7_quality": op7_quality,
    "op8_vector_search": op8_vector_search,
    "op9_secrets": op9_secrets, "op10_mixing": op10_mixing, "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants, "op13_line_dedup": op13_line_dedup,
}

_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_SIZE, _N = sharding.TABLE_SIZE, len(sharding.SHARDS)
#: CRC-32 of a list of byte values: the table of the reflected polynomial, then a step per byte.
_CRC_TABLE = """crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)
                       ORDER BY i) AS steps FROM range(256) r(i))"""
_CRC = "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {}), lambda c, b: xor(steps[xor(c & 255, b) + 1], c >> 8)))"
_BYTES = "list_transform(range(strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)"

ORACLES: dict[str, str] = {
    "op2_sharding": f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name,
         {_HASH.format("'shard-' || lpad(i::VARCHAR, 2, '0') || '/offset'")} % {_SIZE} AS first,
         {_HASH.format("'shard-' || lpad(i::VARCHAR, 2, '0') || '/skip'")} % {_SIZE - 1} + 1 AS skip
  FROM range({_N}) r(i)
), orders AS (
  SELECT list(list_transform(range({_SIZE}), lambda j: (first + j * skip) % {_SIZE}) ORDER BY i) AS prefer FROM shards
), turns AS (
  SELECT 0 AS turn, -1::BIGINT AS slot, list_transform(range({_SIZE}), lambda x: false) AS taken
  UNION ALL
  SELECT turn + 1, pick, list_transform(taken, lambda x, k: x OR k = pick + 1)
  FROM (SELECT turn, taken, list_filter(prefer[turn % {_N} + 1], lambda s: NOT taken[s + 1])[1] AS pick
        FROM turns, orders WHERE turn < {_SIZE})
), slots AS (SELECT slot, (turn - 1) % {_N} AS i FROM turns WHERE turn > 0)
SELECT doc_id, source, slot::INTEGER AS slot, name AS shard
FROM (SELECT doc_id, source, {_HASH.format("coalesce(doc_id::VARCHAR, '')")} % {_SIZE} AS slot FROM documents)
JOIN slots USING (slot) JOIN shards USING (i)""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f""",
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.v FROM reach r JOIN links l ON l.u = r.other
), n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT r.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.other) AS component_id, r.vec_id = min(r.other) AS kept
FROM reach r LEFT JOIN n ON n.u = r.vec_id GROUP BY r.vec_id""",
    "op6_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS grams
  FROM w
), n AS (SELECT doc_id, len(grams) AS n FROM s), g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other
)
SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM n JOIN reach r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n""",
    "op10_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         {_HASH.format("coalesce(doc_id::VARCHAR, '')")} AS key FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn_rank FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((turn_rank - 1) % 3 + 1)::BIGINT] AS weight FROM s),
o AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(source_size) OVER (ORDER BY source_size / weight, turn_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    sum(weight) OVER (ORDER BY source_size / weight, turn_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w
), l AS (SELECT *, (total - 3 * before)::DOUBLE / open_weight AS level FROM o),
t AS (
  SELECT source, source_size, least(3.0 * source_size::DOUBLE, weight * (
    SELECT level FROM l WHERE level * weight <= 3 * source_size ORDER BY source_size / weight, turn_rank LIMIT 1)) AS target FROM l
), b AS (SELECT *, floor(target)::BIGINT AS words, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before FROM d)
SELECT doc_id, size, b.source_size, target, epochs, rest, epochs * size + rest AS taken FROM (
  SELECT r.doc_id, r.size, b.*, greatest(0, least(r.size, words - epochs * source_size - r.before)) AS rest
  FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source) b""",
    "op11_periodic_runs": rf"""
WITH {_CRC_TABLE}, d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         {_CRC.format(_BYTES.format("coalesce(doc_id::VARCHAR, '')"))} AS h FROM documents, crc
), a AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (SELECT id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1])
                            ELSE w END AS w FROM p),
words AS (SELECT id, n, unnest(w) AS word, unnest(range(n)) AS i FROM t),
same AS (SELECT x.id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.id = y.id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT id, q, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island, i FROM same),
stretches AS (SELECT id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT id, start, length, min(q) AS period FROM stretches GROUP BY id, start, length),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM runs),
r AS (SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
             min(start) FILTER (place = 1) AS start, min(length) FILTER (place = 1) AS length, min(period) FILTER (place = 1) AS period FROM ranked GROUP BY id),
gone AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.id, string_agg(word, ' ' ORDER BY w.i) AS collapsed FROM words w ANTI JOIN gone g ON w.id = g.id AND w.i = g.i GROUP BY w.id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM t LEFT JOIN r USING (id) LEFT JOIN kept USING (id)""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE}, tokens AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), counted AS (SELECT doc, run, count(*) AS n FROM tokens GROUP BY doc, run),
hashed AS (SELECT run, n, {_CRC.format(_BYTES.format("doc || ':' || run"))} AS h FROM counted, crc),
typed AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
-- Words that differ by one edit share the word less one letter at the same place, or one is the other less a letter.
less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, l.word FROM v JOIN less l ON v.word = l.rest
  UNION SELECT l.word, v.word FROM v JOIN less l ON v.word = l.rest
), best AS (
  SELECT p.word, count(*) AS n_near, max(v.n) AS top, first(p.near ORDER BY v.n DESC, encode(p.near)) AS near
  FROM pairs p JOIN v ON v.word = p.near GROUP BY p.word
), forms AS (
  SELECT v.word, v.n, CASE WHEN top >= 2 * v.n THEN near END AS form, CASE WHEN top >= 2 * v.n THEN top END AS form_n, coalesce(n_near, 0) AS n_near
  FROM v LEFT JOIN best USING (word)
), walk AS (
  SELECT word, coalesce(form, word) AS at FROM forms
  UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL AND w.at <> w.word
), ends AS (SELECT w.word, w.at AS root FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NULL)
SELECT f.word, n, form, root, n_near, form_n FROM forms f JOIN ends USING (word)""",
    "op13_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT id, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.holder AS gone FROM k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY id, doc_id""",
}
