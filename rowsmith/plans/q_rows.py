"""Registered queries: row views, creation, patches, deletion, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.contract import Contract, Field
from rowsmith.functions import canon, text
from rowsmith.operators import catalog, patches, rows
from rowsmith.plans import inputs
from rowsmith.plans.inputs import load, plain
from rowsmith.plans.q_versions import USR, R
from rowsmith.plans.registry import query

LIVE = f"{R}, l AS (SELECT * FROM r WHERE NOT deleted)"


def at():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def review(spark: SparkSession, d: str) -> DataFrame:
    return inputs.review_rows(spark, d)


# --- Filters and views --------------------------------------------------


@query("f01_live_rows", f"WITH {LIVE} SELECT id, status FROM l")
def live_rows(spark, d):
    return rows.live(review(spark, d)).select("id", "status")


@query("f02_by_status", f"WITH {R} SELECT id, assignee FROM r WHERE status = 'needs_review'")
def by_status(spark, d):
    return rows.by_status(review(spark, d), "needs_review").select("id", "assignee")


@query("f03_by_assignee", f"WITH {R} SELECT id, status FROM r WHERE assignee = 'u2'")
def by_assignee(spark, d):
    return rows.by_assignee(review(spark, d), "me", me="u2").select("id", "status")


@query("f04_text_search", f"WITH {R} SELECT id FROM r WHERE body ILIKE '%th_ %' ESCAPE '\\' OR source ILIKE '%th_ %' ESCAPE '\\' OR id ILIKE '%th_ %' ESCAPE '\\'")
def text_search(spark, d):
    return rows.text_search(review(spark, d), inputs.REVIEW_CONTRACT, "th_ ").select("id")


def _incomplete(spark, d) -> DataFrame:
    """Review rows whose body is dropped for every seventh document."""
    df = review(spark, d)
    seventh = F.pmod(F.regexp_extract("id", r"([0-9]+)", 1).cast("bigint"), F.lit(7)) == 0
    return df.withColumn("data", F.when(seventh, F.map_filter("data", lambda k, _: k != "body")).otherwise(F.col("data")))


@query("f05_missing_required", f"WITH {LIVE} SELECT id FROM l WHERE created_seq % 7 = 0 OR trim(body) = ''")
def missing_required(spark, d):
    return rows.missing_required(rows.live(_incomplete(spark, d)), inputs.REVIEW_CONTRACT).select("id")


@query(
    "f06_named_views",
    f"""WITH {LIVE} SELECT 'all' AS view, id FROM l UNION ALL SELECT 'my_queue', id FROM l WHERE assignee = 'u1'
    UNION ALL SELECT 'needs_review', id FROM l WHERE status = 'needs_review'
    UNION ALL SELECT 'missing_required', id FROM l WHERE created_seq % 7 = 0 OR trim(body) = ''
    UNION ALL SELECT 'custom', id FROM l WHERE status = 'needs_review' AND assignee = 'u1' AND (body ILIKE '%e%' OR source ILIKE '%e%' OR id ILIKE '%e%')
     AND created_seq % 7 <> 0
    UNION ALL SELECT 'custom', id FROM l WHERE status = 'needs_review' AND assignee = 'u1' AND (source ILIKE '%e%' OR id ILIKE '%e%') AND created_seq % 7 = 0""",
)
def named_views(spark, d):
    df = _incomplete(spark, d)
    found = [
        rows.named_view(df, inputs.REVIEW_CONTRACT, name, me="u1").select(F.lit(name).alias("view"), "id")
        for name in rows.NAMED_VIEWS
    ]
    custom = rows.view(df, inputs.REVIEW_CONTRACT, status="needs_review", assignee="me", q="e", me="u1")
    out = custom.select(F.lit("custom").alias("view"), "id")
    for v in found:
        out = out.unionByName(v)
    return out


@query("l02_row_listing", f"WITH {LIVE} SELECT id, rev, CAST(created_seq AS BIGINT) AS created_micros FROM l")
def listing(spark, d):
    return rows.listing(review(spark, d)).select("id", "rev", F.unix_micros("created_at").alias("created_micros"))


@query("typed_view", "SELECT concat('ev-', event_id) AS id, event_type AS kind, CAST(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS DOUBLE) AS score, event_id % 3 = 0 AS flagged, CAST(len(CASE WHEN event_id % 2 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS BIGINT) AS tags, CAST(ts AS DATE)::VARCHAR AS as_of, props::JSON IS NOT NULL AS has_blob, concat('line', chr(10), event_id) AS note FROM events")
def typed_view(spark, d):
    """Rows with a column of each type, one of them called id, seen as typed columns."""
    contract = Contract.of(
        Field("id", "text"), Field("kind", "select"), Field("score", "number"), Field("flagged", "boolean"),
        Field("tags", "multi_select"), Field("as_of", "date"), Field("blob", "json"), Field("note", "long_text"),
    )
    events = load(spark, d, "SELECT event_id, event_type, value, ts, props FROM {events}")
    number = F.col("event_id")
    data = canon.as_map(
        {
            "id": text.quote(F.concat(F.lit("ev-"), number)),
            "kind": text.quote(F.col("event_type")),
            "score": text.number_text(F.col("value").cast("decimal(18,2)").cast("string")),
            "flagged": (number % 3 == 0).cast("string"),
            "tags": F.when(number % 2 == 0, '["a","b"]').otherwise('["a"]'),
            "as_of": text.quote(F.col("ts").cast("date").cast("string")),
            "blob": F.col("props"),
            "note": text.quote(F.concat(F.lit("line\n"), number)),
        }
    )
    wide = rows.typed_view(events.select(number.cast("string").alias("id"), F.lit("draft").alias("status"), data.alias("data")), contract)
    return wide.select("data.*").select(
        "id", "kind", "score", "flagged", F.size("tags").cast("bigint").alias("tags"), F.col("as_of").cast("string").alias("as_of"),
        F.col("blob").isNotNull().alias("has_blob"), "note",
    )


# --- Keys, creation, deletion -------------------------------------------


@query("j02_key_conflicts", f"""WITH {LIVE}, w AS (SELECT concat('doc-', doc_id + 1) AS id, concat('doc-', doc_id) AS row_key FROM documents WHERE doc_id % 2 = 0
 UNION ALL SELECT concat('doc-', doc_id), concat('doc-', doc_id) FROM documents WHERE doc_id % 2 = 1)
 SELECT w.id, w.row_key, l.id AS other_id FROM w JOIN l ON w.row_key = l.id WHERE w.id <> l.id""")
def key_conflicts(spark, d):
    wanted = load(spark, d, """SELECT concat('doc-', doc_id + 1) AS id, concat('doc-', doc_id) AS row_key FROM {documents} WHERE doc_id % 2 = 0
      UNION ALL SELECT concat('doc-', doc_id), concat('doc-', doc_id) FROM {documents} WHERE doc_id % 2 = 1""")
    return rows.key_conflicts(wanted, review(spark, d))


# New rows: every key twice, from live and deleted documents and beyond them.
_NEW = """SELECT doc_id + 1 AS row_idx, concat('doc-', doc_id + 500 - doc_id % 2) AS key,
 CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE 'en' END AS lang, text AS body FROM {documents}"""


@query(
    "m01_create_rows",
    f"""WITH {LIVE}, n AS ({plain(_NEW)}), e AS (SELECT *, CASE WHEN trim(body) = '' THEN 'column ''body'': required' WHEN lang = 'xx' THEN 'column ''lang'': ''xx'' is not one of [''en'', ''de'', ''fr'']' END AS bad FROM n),
    f AS (SELECT key, min(row_idx) AS first FROM e WHERE bad IS NULL GROUP BY key)
    SELECT 'created' AS outcome, e.row_idx, e.key AS detail FROM e JOIN f ON e.key = f.key WHERE bad IS NULL AND row_idx = first AND e.key NOT IN (SELECT id FROM l)
    UNION ALL SELECT 'rejected', e.row_idx, bad FROM e WHERE bad IS NOT NULL
    UNION ALL SELECT 'rejected', e.row_idx, concat('key ''', e.key, ''' already exists') FROM e JOIN f ON e.key = f.key
     WHERE bad IS NULL AND (row_idx > first OR e.key IN (SELECT id FROM l))""",
)
def create_rows(spark, d):
    df = load(spark, d, _NEW)
    data = canon.as_map({"id": text.quote(F.col("key")), "body": text.quote(F.col("body")), "lang": text.quote(F.col("lang"))})
    table, rejected = rows.create_rows(
        review(spark, d), df.select("row_idx", data.alias("data")), inputs.REVIEW_CONTRACT, "docs", "u9", at()
    )
    made = table.filter(F.col("updated_by") == "u9")
    position = (F.unix_micros("created_at") - F.unix_micros(at())).alias("row_idx")
    return made.select(F.lit("created").alias("outcome"), position, F.col("row_key").alias("detail")).unionByName(
        rejected.select(F.lit("rejected").alias("outcome"), "row_idx", F.col("reason").alias("detail"))
    )


# Every document is asked for twice or three times, in an order that the rev does not follow.
_REQ = """SELECT concat('doc-', doc_id) AS id, 3 * doc_id + 1 AS seq, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 9 ELSE 1 + doc_id % 3 END AS expected_rev FROM {documents}
 UNION ALL SELECT concat('doc-', doc_id), 3 * doc_id + 2, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 + doc_id % 3 END FROM {documents}
 UNION ALL SELECT concat('doc-', doc_id), 3 * doc_id, 2 FROM {documents} WHERE doc_id % 3 = 1 AND doc_id % 2 = 0
 UNION ALL SELECT concat('gone-', doc_id), 3 * doc_id, 1 FROM {documents} WHERE doc_id % 50 = 0"""
_DELETED = f"""q AS ({plain(_REQ)}), h AS (SELECT q.id, min(q.seq) AS hit FROM q JOIN l ON q.id = l.id WHERE q.expected_rev = l.rev GROUP BY q.id),
 o AS (SELECT q.id, q.seq, CASE WHEN l.id IS NULL OR q.seq > h.hit THEN 'not_found' WHEN q.expected_rev IS NULL THEN 'rev_required'
  WHEN q.seq = h.hit THEN 'deleted' ELSE 'conflict' END AS outcome FROM q LEFT JOIN l ON q.id = l.id LEFT JOIN h ON q.id = h.id)"""


def _soft_deleted(spark, d):
    return rows.soft_delete(review(spark, d), load(spark, d, _REQ), "u9", at())


@query("m04_soft_delete", f"WITH {LIVE}, {_DELETED} SELECT r.id, r.rev + coalesce(h.n, 0) AS rev, r.deleted OR h.n IS NOT NULL AS deleted FROM r LEFT JOIN (SELECT id, 1 AS n FROM o WHERE outcome = 'deleted') h ON r.id = h.id")
def soft_delete(spark, d):
    table, _, _ = _soft_deleted(spark, d)
    return table.select("id", F.col("rev").cast("bigint").alias("rev"), F.col("deleted_at").isNotNull().alias("deleted"))


@query("m04_soft_delete_outcomes", f"WITH {LIVE}, {_DELETED} SELECT id, seq, outcome FROM o")
def soft_delete_outcomes(spark, d):
    return _soft_deleted(spark, d)[1].select("id", F.col("seq").cast("bigint").alias("seq"), "outcome")


@query("m04_soft_delete_edits", f"WITH {LIVE}, {_DELETED} SELECT id AS row_id, 'deleted' AS field, 'false' AS old_value, 'true' AS new_value FROM o WHERE outcome = 'deleted'")
def soft_delete_edits(spark, d):
    return _soft_deleted(spark, d)[2].select("row_id", "field", "old_value", "new_value")


@query("m05_bulk_delete", f"WITH {LIVE} SELECT id, deleted OR created_seq % 6 = 1 AS deleted, CASE WHEN NOT deleted AND created_seq % 6 = 1 THEN rev + 1 ELSE rev END AS rev FROM r")
def bulk_delete(spark, d):
    table = review(spark, d)
    sixth = F.pmod(F.regexp_extract("id", r"([0-9]+)", 1).cast("bigint"), F.lit(6)) == 1
    keys = rows.live(table).filter(sixth).select("row_key")
    after, _, _ = rows.bulk_delete(table, "u9", at(), keys=keys)
    return after.select("id", F.col("deleted_at").isNotNull().alias("deleted"), F.col("rev").cast("bigint").alias("rev"))


@query("j11_not_found", f"WITH {LIVE} SELECT concat('doc-', doc_id * 2) AS id FROM documents WHERE concat('doc-', doc_id * 2) NOT IN (SELECT id FROM l)")
def not_found(spark, d):
    wanted = load(spark, d, "SELECT concat('doc-', doc_id * 2) AS id FROM {documents}")
    return rows.not_found(review(spark, d), wanted, "id")


@query("j12_unknown_assignees", f"WITH {USR} SELECT event_id, concat('u', user_id % 40) AS assignee FROM events WHERE concat('u', user_id % 40) NOT IN (SELECT id FROM u)")
def unknown_assignees(spark, d):
    asked = load(spark, d, "SELECT event_id, concat('u', user_id % 40) AS assignee FROM {events}")
    return catalog.unknown_assignees(asked, load(spark, d, inputs.USERS)).select("event_id", "assignee")


@query("j17_row_history", f"WITH {LIVE}, c AS ({plain(inputs.COMMENTS)}) SELECT c.row_id, c.event_id, c.user_id, c.body FROM c JOIN l ON c.row_id = l.id")
def row_history(spark, d):
    return rows.history(rows.live(review(spark, d)), load(spark, d, inputs.COMMENTS)).select("row_id", "event_id", "user_id", "body")


@query("l07_comments_by_time", f"WITH c AS ({plain(inputs.COMMENTS)}) SELECT row_id, event_id, strftime(c.at, '%Y-%m-%d %H:%M:%S') AS at FROM c")
def comments_by_time(spark, d):
    comments = load(spark, d, inputs.COMMENTS)
    return comments.orderBy("at", "event_id").select("row_id", "event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


# --- Patches ------------------------------------------------------------

_PATCH = f"p AS ({plain(inputs.PATCHES)})"
# The last value per document of a field that accepted patches set.
_LAST = """a AS (SELECT id, count(*) AS n, max_by(status, seq) FILTER (status IS NOT NULL) AS status, max_by(source, seq) FILTER (source IS NOT NULL) AS source,
 max_by(lang, seq) FILTER (lang IS NOT NULL) AS lang, max_by(coalesce(assignee, ''), seq) FILTER (set_assignee) AS assignee FROM p WHERE passes GROUP BY id)"""


def judged(spark, d) -> DataFrame:
    return patches.judge_patches(review(spark, d), inputs.patch_table(spark, d), inputs.REVIEW_CONTRACT)


@query("w04_sequential_revs", f"WITH {_PATCH} SELECT id, seq, CASE WHEN NOT known THEN 'not_found' WHEN passes THEN 'accepted' WHEN k % 4 = 0 THEN 'conflict' ELSE 'invalid' END AS outcome FROM p")
def sequential_revs(spark, d):
    return judged(spark, d).select("id", "seq", "outcome")


@query(
    "m02_apply_patches",
    f"""WITH {R}, {_PATCH}, {_LAST}
    SELECT r.id, coalesce(a.status, r.status) AS status, r.rev + coalesce(a.n, 0) AS rev, coalesce(a.source, r.source) AS source,
     coalesce(a.lang, r.lang) AS lang, CASE WHEN a.assignee IS NULL THEN r.assignee WHEN a.assignee <> '' THEN a.assignee END AS assignee
    FROM r LEFT JOIN a ON r.id = a.id""",
)
def apply_patches(spark, d):
    after = patches.apply_patches(review(spark, d), judged(spark, d), inputs.REVIEW_CONTRACT, "u9", at())
    return after.select(
        "id", "status", F.col("rev").cast("bigint").alias("rev"),
        text.unquote(F.col("data")["source"]).alias("source"), text.unquote(F.col("data")["lang"]).alias("lang"), "assignee",
    )


def _audit(field: str, value: str, stored: str, where: str) -> str:
    return f"""SELECT id AS row_id, seq, '{field}' AS field, to_json(before)::VARCHAR AS old_value, to_json(value)::VARCHAR AS new_value FROM (
     SELECT p.id, p.seq, {value} AS value, CASE WHEN lag(p.seq) OVER w IS NULL THEN r.{stored} ELSE lag({value}) OVER w END AS before
     FROM p JOIN r ON p.id = r.id WHERE p.passes AND {where} WINDOW w AS (PARTITION BY p.id ORDER BY p.seq)) WHERE value IS DISTINCT FROM before"""


@query(
    "m03_audit_rows",
    f"WITH {R}, {_PATCH} "
    + " UNION ALL ".join(
        [
            _audit("status", "p.status", "status", "p.status IS NOT NULL"),
            _audit("assignee", "p.assignee", "assignee", "p.set_assignee"),
            _audit("source", "p.source", "source", "p.source IS NOT NULL"),
            _audit("lang", "p.lang", "lang", "p.lang IS NOT NULL"),
        ]
    ),
)
def audit_rows(spark, d):
    log = patches.patch_edits(review(spark, d), judged(spark, d), "u9", at())
    return log.select("row_id", "seq", "field", "old_value", "new_value")


@query(
    "m02_data_patches",
    f"""WITH {R}, p AS (SELECT concat('doc-', doc_id) AS id, doc_id % 4 AS k FROM documents),
    j AS (SELECT p.id, k, r.lang, r.body, r.id IS NULL OR r.deleted AS gone FROM p LEFT JOIN r ON p.id = r.id)
    SELECT id, CASE WHEN gone THEN 'not_found' WHEN k = 1 OR trim(body) = '' OR lang NOT IN ('en', 'de', 'fr') AND k <> 0 THEN 'invalid' ELSE 'accepted' END AS outcome FROM j""",
)
def data_patches(spark, d):
    """Patches of single fields: the merged row must satisfy the whole contract."""
    asked = load(spark, d, "SELECT concat('doc-', doc_id) AS id, doc_id, 1 + doc_id % 3 AS expected_rev FROM {documents}")
    kind = F.col("doc_id") % 4
    data = canon.as_map(
        {
            "lang": F.when(kind == 0, '"en"'),
            "n_chars": F.when(kind == 1, '"many"').when(kind == 2, "7"),
            "source": F.when(kind == 3, '"patched"'),
        }
    )
    batch = asked.select(
        "id", F.col("doc_id").cast("bigint").alias("seq"), F.col("expected_rev").cast("int").alias("expected_rev"), data.alias("data"),
        F.lit(None).cast("string").alias("status"), F.lit(False).alias("set_assignee"), F.lit(None).cast("string").alias("assignee"),
    )
    return patches.judge_patches(review(spark, d), batch, inputs.REVIEW_CONTRACT).select("id", "outcome")


_CLAIMS = """SELECT concat('doc-', doc_id) AS id, doc_id AS seq, 1 + doc_id % 3 AS expected_rev, lang, text,
 CASE WHEN doc_id % 5 = 0 THEN concat('new-', doc_id - doc_id % 20) WHEN doc_id % 5 = 1 THEN concat('doc-', doc_id) ELSE concat('doc-', doc_id + 1) END AS key FROM {documents}"""


@query(
    "m02_key_patches",
    f"""WITH RECURSIVE {R}, c AS ({plain(_CLAIMS)}), o AS (SELECT c.id, seq, key, row_number() OVER (PARTITION BY key ORDER BY seq) AS nth,
     r.id IS NULL OR r.deleted AS gone, trim(c.text) = '' OR c.lang NOT IN ('en', 'de', 'fr') AS bad FROM c LEFT JOIN r ON c.id = r.id),
    live AS (SELECT id FROM r WHERE NOT deleted),
    fine AS (SELECT key, min(seq) AS first FROM o WHERE NOT gone AND NOT bad AND key LIKE 'new-%' GROUP BY key)
    SELECT o.id, CASE WHEN gone THEN 'not_found' WHEN bad THEN 'invalid' WHEN o.key = o.id THEN 'accepted'
     WHEN o.key LIKE 'new-%' THEN CASE WHEN seq = first THEN 'accepted' ELSE 'key_taken' END
     WHEN o.key IN (SELECT id FROM live) THEN 'key_taken' ELSE 'accepted' END AS outcome
    FROM o LEFT JOIN fine ON o.key = fine.key""",
)
def key_patches(spark, d):
    """Every document asks for another key: a new one that four ask for, its own, or its neighbour's.

    A neighbour gives its key up later at the earliest, so it is taken unless nobody lives there.
    """
    asked = load(spark, d, _CLAIMS)
    batch = asked.select(
        "id", F.col("seq").cast("bigint").alias("seq"), F.col("expected_rev").cast("int").alias("expected_rev"),
        canon.as_map({"id": text.quote(F.col("key"))}).alias("data"),
        F.lit(None).cast("string").alias("status"), F.lit(False).alias("set_assignee"), F.lit(None).cast("string").alias("assignee"),
    )
    return patches.judge_patches(review(spark, d), batch, inputs.REVIEW_CONTRACT).select("id", "outcome")


@query("j18_forget_deleted_keys", f"WITH p AS ({plain(inputs.PULLED)}), s AS ({plain(inputs.SERVER)}) SELECT row_key, rev FROM p WHERE row_key NOT IN (SELECT row_key FROM s WHERE deleted)")
def forget_deleted_keys(spark, d):
    from rowsmith.operators import sync

    gone = inputs.server_rows(spark, d).filter(F.col("deleted_at").isNotNull())
    return sync.forget_keys(inputs.pulled_state(spark, d), gone).select("row_key", F.col("rev").cast("bigint").alias("rev"))


