"""The registered queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import (
    centroids,
    chat,
    decontaminate,
    exact_dedup,
    langid,
    minhash,
    mixing,
    parsing,
    quality,
    sharding,
    spelling,
    suffix_dedup,
    toxicity,
)
from rowsmith.llm.common import sha256_hex, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- 2: chat formatting ---------------------------------------------------

_SAYING = "</s>[INST] ok [/INST]"


@query(
    "op2_chat_formatting",
    f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{_SAYING}' UNION ALL SELECT -7, 1, 'assistant', '{_SAYING}'),
    s AS (
      SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
        CAST(sum(24 + length(role) + length(text)
          + length(text) - length(regexp_replace(text, '([<\\[])(\\\\*)(\\||/?s>|/?INST\\])', '\\2\\3', 'g'))) AS BIGINT) AS formatted_chars
      FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
      formatted_chars FROM s""",
)
def op2(spark, d):
    """Rebuild every conversation from its streamed log, format it and read the turns back."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
        F.lit(_SAYING).alias("text"),
    )
    rows = rows.unionByName(extra.withColumn("turn", F.col("turn").cast("long")))
    out = chat.format_log(chat.streamed(rows, "conv_id", "turn", "role", "text"))
    read = out.select(
        F.col("conv").alias("conv_id"),
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("segments")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(lines).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


# --- 8: benchmark decontamination -----------------------------------------


@query(
    "op8_benchmark_decontamination",
    r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    s AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
    iw AS (
      SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
      FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s)),
    ks AS (SELECT DISTINCT k FROM iw),
    h AS (
      SELECT doc_id, i, k, win FROM (
        SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k))
      WHERE (k, win) IN (SELECT (k, win) FROM iw)),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
    n AS (
      SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
      FROM (SELECT DISTINCT h.doc_id, iw.item_id FROM h JOIN iw ON h.k = iw.k AND h.win = iw.win) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
    FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""",
)
def op8(spark, d):
    """Hit words, items and the verdict of every document against the whole benchmark."""
    found = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256_hex(F.array_join("items", ",")).alias("items_sha256"),
        "contaminated",
    )


# --- 9: exact dedup -------------------------------------------------------


@query(
    "op9_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
      count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
)
def op9(spark, d):
    """The copy that stays of every group of documents with equal texts."""
    return exact_dedup.duplicates(table(spark, d, "documents"))


# --- 1, 3, 10: models; SQL cannot express them -------------------------------


@query("op1_quality_classifier")
def op1(spark, d):
    """Quality of every document by gated attention over its passages."""
    found = quality.scores(table(spark, d, "documents"), table(spark, d, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op3_toxicity")
def op3(spark, d):
    """Toxicity of every document by a linear classifier of weakly supervised labels."""
    found = toxicity.scores(table(spark, d, "documents"), table(spark, d, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op10_language_id")
def op10(spark, d):
    """The language of every document, and how many spans of one language it has."""
    docs = table(spark, d, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


# --- 4, 5: mixing and sharding ------------------------------------------------


@query("op4_mixing")
def op4(spark, d):
    """Every copy of every document in the mix of sources, in the order of ``progress``."""
    mix = mixing.mixed(table(spark, d, "documents"))
    return mix.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens"), "epoch", "block", "progress")


@query("op5_sharding")
def op5(spark, d):
    """Shard and slot of every document after the two passes; counts differ by one at most."""
    out = sharding.into_shards(table(spark, d, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        sharding.record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# --- 7: suffix-array dedup -----------------------------------------------------


@query("op7_suffix_dedup")
def op7(spark, d):
    """What is left of every document without repeated strings of 400 bytes."""
    found = suffix_dedup.repeats(table(spark, d, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
        (F.col("n_bytes") - F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])).alias("kept_bytes"),
    )


# --- 6: near dedup --------------------------------------------------------------


@query("op6_minhash_near_dedup")
def op6(spark, d):
    """The group of near copies of every document, and the one that stays."""
    found = minhash.groups(table(spark, d, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


# --- 11: spelling variants ----------------------------------------------------------


def _crc_table() -> str:
    """The remainders of the 16 nibbles, for crc32 in SQL."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(str(n))
    return f"[{', '.join(out)}]"


@query(
    "op11_spelling_variants",
    f"""
    WITH r AS (
      SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    g AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM r WHERE length(run) >= 7 GROUP BY id, run),
    h AS (
      SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x)),
        lambda i: CAST(strpos('0123456789ABCDEF', substr(x, xor(i, 1) + 1, 1)) - 1 AS BIGINT))),
        lambda a, b: xor(a >> 4, CAST({_crc_table()}[(xor(a, b) & 15) + 1] AS BIGINT)))) AS h FROM g),
    w AS (
      SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
      FROM h),
    v AS MATERIALIZED (
      SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    d AS (
      SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
    p AS (
      SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.i = b.i AND a.k = b.k AND a.word <> b.word
      UNION SELECT v.word, d.word, d.n FROM v JOIN d ON v.word = d.k
      UNION SELECT d.word, v.word, v.n FROM v JOIN d ON v.word = d.k),
    b AS (
      SELECT v.word, v.n, count(p.other) AS n_near, first(p.other ORDER BY p.n DESC, encode(p.other)) AS other,
        max(p.n) AS other_n FROM v LEFT JOIN p ON v.word = p.word GROUP BY v.word, v.n),
    f AS MATERIALIZED (
      SELECT word, n, n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM b),
    c AS (
      WITH RECURSIVE c(word, root, next) AS (
        SELECT word, word, form FROM f UNION ALL SELECT c.word, c.next, f.form FROM c JOIN f ON c.next = f.word)
      SELECT word, root FROM c WHERE next IS NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN c ON f.word = c.word""",
)
def op11(spark, d):
    """Every word that occurs twice or more, the word it is a variant of, and the last of that chain."""
    found = spelling.variants(table(spark, d, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


# --- 12: document fingerprints ------------------------------------------------------


@query("op12_document_fingerprints")
def op12(spark, d):
    """The fingerprints of every document and of its edited text, and how alike they are."""
    return parsing.fingerprints(table(spark, d, "documents"))


# --- 13: centroid clustering ------------------------------------------------------

_DISTANCE = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))"


def _round(n: int) -> str:
    """SQL of one round: nearest centroids of m{n}, then the means m{n + 1}."""
    return f"""
    a{n} AS MATERIALIZED (
      SELECT v.vec_id, v.rid, v.v, arg_min(c.c, d.d * 1000 + c.c) AS c, min(d.d) AS d
      FROM q v, m{n} c, LATERAL (SELECT CAST({_DISTANCE} AS HUGEINT) AS d) d GROUP BY v.vec_id, v.rid, v.v),
    s{n} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY c, i),
    m{n + 1} AS MATERIALIZED (
      SELECT m.c, coalesce(t.v, m.v) AS v FROM m{n} m LEFT JOIN (
        SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{n} GROUP BY c) t ON m.c = t.c)"""


@query(
    "op13_centroid_clustering",
    f"""
    WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings),
    k AS (SELECT * FROM x WHERE len(x) = 64 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    q AS MATERIALIZED (
      SELECT vec_id, row_number() OVER () AS rid, list_transform(x, lambda e: CAST(floor(64 * e) AS BIGINT)) AS v FROM k),
    m0 AS MATERIALIZED (
      SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v
      FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM q ORDER BY h, v LIMIT 16)),
    {",".join(_round(n) for n in range(4))}
    SELECT a.vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
      CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m3.v, ',')) AS centroid_sha256
    FROM a3 a JOIN m3 ON a.c = m3.c""",
)
def op13(spark, d):
    """The cluster of every vector after three exact rounds."""
    return centroids.clusters(table(spark, d, "embeddings"))
