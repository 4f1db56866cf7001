"""Registered queries: snapshots, hashes, versions, differences, catalog joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.functions import canon, checks, text
from rowsmith.operators import catalog, importing, versions
from rowsmith.plans import durable, inputs
from rowsmith.plans.inputs import load, plain
from rowsmith.plans.registry import query
from rowsmith.sources import snapshots, store

R = f"r AS ({plain(inputs.REVIEW)})"
REVIEW_DATA = (
    """concat('{"body":', to_json(body), ',"id":', to_json(id), ',"lang":', to_json(lang), ',"n_chars":', n_chars, """
    """',"source":', to_json(source), '}')"""
)
REVIEW_LINE = f"""concat('{{"data":', {REVIEW_DATA}, ',"id":', to_json(id), ',"status":', to_json(status), '}}')"""
MONEY = "CAST(CAST({0} AS DOUBLE) AS VARCHAR)"
ORDER_DATA = (
    """concat('{"as_of":', to_json(as_of), ',"priority":', to_json(priority), """
    f"""CASE WHEN total IS NULL THEN '' ELSE concat(',"total":', {MONEY.format('total')}) END, '}}')"""
)
ORDER_LINE = f"""concat('{{"data":', {ORDER_DATA}, ',"id":', to_json(id), ',"status":', to_json(status), '}}')"""
TREE = """
 leaf AS (SELECT sha256(line) AS h, created_seq, id FROM lines),
 n AS (SELECT count(*) AS n FROM lines),
 t6 AS (SELECT substr(h, 1, 6) AS p, sha256(string_agg(h, '' ORDER BY created_seq, id)) AS h FROM leaf GROUP BY 1),
 t4 AS (SELECT substr(p, 1, 4) AS p, sha256(string_agg(p || h, '' ORDER BY p)) AS h FROM t6 GROUP BY 1),
 t2 AS (SELECT substr(p, 1, 2) AS p, sha256(string_agg(p || h, '' ORDER BY p)) AS h FROM t4 GROUP BY 1),
 root AS (SELECT 'sha256:' || sha256(string_agg(p || h, '' ORDER BY p)) AS content_hash FROM t2)
"""


def folder_for(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    import uuid

    return f"{durable.shared_dir(spark)}/rowsmith/queries/{name}-{uuid.uuid4().hex}"


def review_snapshot(spark, d, include_unapproved=False):
    return versions.snapshot(inputs.review_rows(spark, d), inputs.REVIEW_CONTRACT, include_unapproved)


def order_snapshot(spark, d, sql):
    return versions.snapshot(inputs.order_rows(spark, d, sql), inputs.ORDER_CONTRACT, include_unapproved=True)


@query("f08_version_selection", f"WITH {R} SELECT id, status FROM r WHERE NOT deleted AND status = 'approved'")
def version_selection(spark: SparkSession, d: str) -> DataFrame:
    return versions.selection(inputs.review_rows(spark, d)).select("id", "status")


@query("p16_prune_fields", f"""WITH {R} SELECT id, concat('{{"id":', to_json(id), ',"lang":', to_json(lang), '}}') AS data FROM r""")
def prune_fields(spark, d):
    rows = inputs.review_rows(spark, d).withColumn("data", canon.prune(F.col("data"), ["id", "lang"]))
    return rows.select("id", canon.object_text(canon.cells_of("data"), ["id", "lang", "body", "source"]).alias("data"))


@query("p17_canonical_line", f"WITH {R} SELECT id, {REVIEW_LINE} AS line FROM r WHERE NOT deleted")
def canonical_line(spark, d):
    return review_snapshot(spark, d, True).select("id", "line")


@query("p18_row_hash", f"WITH {R} SELECT id, concat('sha256:', sha256({REVIEW_DATA})) AS row_hash FROM r")
def row_hash(spark, d):
    keys = inputs.REVIEW_CONTRACT.active_keys
    return inputs.review_rows(spark, d).select("id", canon.row_hash(canon.cells_of("data"), keys).alias("row_hash"))


@query(
    "g08_content_hash",
    f"WITH {R}, lines AS (SELECT {REVIEW_LINE} AS line, created_seq, id FROM r WHERE NOT deleted AND status = 'approved'), {TREE} "
    "SELECT content_hash, CAST(n.n AS BIGINT) AS row_count FROM root, n",
)
def content_hash(spark, d):
    snap = durable.written(review_snapshot(spark, d), "snapshot")
    return versions.tree_hash(snap)


@query("l04_snapshot_order", f"WITH {R} SELECT id, CAST(created_seq AS BIGINT) AS created_micros FROM r WHERE NOT deleted AND status = 'approved'")
def snapshot_order(spark, d):
    ordered = versions.in_snapshot_order(review_snapshot(spark, d))
    return ordered.select("id", F.unix_micros("created_at").alias("created_micros"))


@query("s12_snapshot_write", f"WITH {R} SELECT id, status, {REVIEW_LINE} AS line FROM r WHERE NOT deleted AND status = 'approved'")
def snapshot_write(spark, d):
    root = folder_for(spark, "write")
    snapshots.write_snapshot(versions.in_snapshot_order(review_snapshot(spark, d)), root, "docs", 1)
    return snapshots.read_snapshot(spark, root, "docs", 1).select("id", "status", "line")


@query("s13_snapshot_read", f"WITH {R} SELECT id, status, {REVIEW_DATA} AS data FROM r WHERE NOT deleted")
def snapshot_read(spark, d):
    root = folder_for(spark, "read")
    snapshots.write_snapshot(review_snapshot(spark, d, True), root, "docs", 1)
    stored = snapshots.read_snapshot(spark, root, "docs", 1)
    keys = inputs.REVIEW_CONTRACT.active_keys
    return stored.select("id", "status", canon.object_text(canon.cells_of("data"), keys).alias("data"))


@query("s14_export_jsonl", f"WITH v AS ({plain(inputs.V0)}) SELECT {ORDER_LINE} AS line FROM v")
def export_flat(spark, d):
    path = folder_for(spark, "export")
    lines = versions.export_line(order_snapshot(spark, d, inputs.V0), inputs.ORDER_CONTRACT)
    snapshots.export_jsonl(lines, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("s16_export_json", f"WITH v AS ({plain(inputs.V0)}) SELECT {ORDER_LINE} AS line, CAST(1 AS BIGINT) AS manifests FROM v")
def export_json(spark, d):
    path = folder_for(spark, "json")
    snap = order_snapshot(spark, d, inputs.V0)
    manifest = snap.agg(F.count("*").alias("row_count")).withColumn("dataset", F.lit("orders"))
    snapshots.export_json(versions.export_line(snap, inputs.ORDER_CONTRACT), manifest, path)
    manifests = spark.read.json(f"{path}/manifest").count()
    return spark.read.text(f"{path}/rows").select(F.col("value").alias("line"), F.lit(manifests).alias("manifests"))


_CUT = f"WITH v AS ({plain(inputs.V0)}), lines AS (SELECT {ORDER_LINE} AS line, created_seq, id FROM v), {TREE} "


def _cut(spark, d, notes=""):
    root = folder_for(spark, "cut")
    rows = inputs.order_rows(spark, d, inputs.V0)
    manifest = versions.cut_version(rows, inputs.ORDER_CONTRACT, "orders", root, 1, "u1", notes, include_unapproved=True)
    return root, manifest


@query("m14_cut_version", _CUT + "SELECT 'orders' AS dataset, 1 AS version, content_hash, CAST(n.n AS BIGINT) AS row_count FROM root, n")
def cut_version(spark, d):
    return _cut(spark, d)[1].select("dataset", "version", "content_hash", "row_count")


def _tree_of(name: str, lines: str) -> str:
    """The tree of the query ``lines(line, created_seq, id)`` as the table ``name(h)``."""
    return f"""{name}l AS (SELECT sha256(line) AS h, created_seq, id FROM ({lines})),
 {name}6 AS (SELECT substr(h, 1, 6) AS p, sha256(string_agg(h, '' ORDER BY created_seq, id, h)) AS h FROM {name}l GROUP BY 1),
 {name}4 AS (SELECT substr(p, 1, 4) AS p, sha256(string_agg(p || h, '' ORDER BY p)) AS h FROM {name}6 GROUP BY 1),
 {name}2 AS (SELECT substr(p, 1, 2) AS p, sha256(string_agg(p || h, '' ORDER BY p)) AS h FROM {name}4 GROUP BY 1),
 {name} AS (SELECT 'sha256:' || sha256(string_agg(p || h, '' ORDER BY p)) AS h FROM {name}2)"""


_LINES = f"SELECT {ORDER_LINE} AS line, created_seq, id FROM v"


@query(
    "m16_verify_version",
    f"""WITH v AS ({plain(inputs.V0)}), {_tree_of("good", _LINES)},
    {_tree_of("bad", f"{_LINES} UNION ALL SELECT line || ' ', created_seq, id FROM ({_LINES}) WHERE id LIKE '%7'")}
    SELECT 'orders' AS dataset, true AS matches, good.h AS actual FROM good
    UNION ALL SELECT 'tampered', false, bad.h FROM bad""",
)
def verify_version(spark, d):
    """A version as it was cut, and one to which rows were added behind its back."""
    root, _ = _cut(spark, d)
    versions.cut_version(inputs.order_rows(spark, d, inputs.V0), inputs.ORDER_CONTRACT, "tampered", root, 1, "u1", include_unapproved=True)
    stored = store.read_version(spark, root, "tampered", 1)
    forged = durable.written(stored.filter(F.col("id").like("%7")).withColumn("line", F.concat("line", F.lit(" "))), "forged")
    bucket = stored.select(F.input_file_name()).first()[0].rsplit("/", 1)[0]
    forged.write.mode("append").parquet(bucket)
    found = []
    for name in ("orders", "tampered"):
        found.append((name, *versions.verify(spark, root, name, 1)))
    return spark.createDataFrame(found, "dataset string, matches boolean, actual string")


# Orders by the month they were made; later, those of the last two years have other priorities.
_MONTHLY = "SELECT id, status, {priority} AS priority, total, as_of, epoch_us(CAST(concat(substr(as_of, 1, 7), '-01') AS TIMESTAMP)) AS created_seq FROM v"
_LATER = "CASE WHEN as_of >= '1997-01-01' THEN '0-LATER' ELSE priority END"


@query(
    "s12_shared_buckets",
    f"""WITH v AS ({plain(inputs.V0)}), x AS ({_MONTHLY.format(priority="priority")}), y AS ({_MONTHLY.format(priority=_LATER)}),
    {_tree_of("one", f"SELECT {ORDER_LINE} AS line, created_seq, id FROM x")}, {_tree_of("two", f"SELECT {ORDER_LINE} AS line, created_seq, id FROM y")},
    n AS (SELECT count(*) AS n, count(*) FILTER (as_of >= '1997-01-01') AS later FROM v)
    SELECT 1 AS version, one.h AS content_hash, n.n AS row_count, n.n AS rows_written FROM one, n
    UNION ALL SELECT 2, two.h, n.n, n.later FROM two, n""",
)
def shared_buckets(spark, d):
    """Two cuts of one dataset: the second writes the months that changed, and both give the hash of a full cut."""
    root = folder_for(spark, "shared")
    rows = inputs.order_rows(spark, d, inputs.V0)
    month = F.to_timestamp(F.concat(F.substring(text.unquote(F.col("data")["as_of"]), 1, 7), F.lit("-01")))
    rows = durable.written(rows.withColumn("created_at", month), "monthly")
    late = text.unquote(F.col("data")["as_of"]) >= "1997-01-01"
    other = F.transform_values("data", lambda k, v: F.when((k == "priority") & late, F.lit('"0-LATER"')).otherwise(v))
    found = []
    for version, table in ((1, rows), (2, rows.withColumn("data", other))):
        cut = versions.cut_version(table, inputs.ORDER_CONTRACT, "orders", root, version, "u1", include_unapproved=True).first()
        written = spark.read.parquet(f"{store.dataset_dir(root, 'orders')}/objects/{cut.home}").count()
        found.append((version, cut.content_hash, cut.row_count, written))
    again = {v: versions.verify(spark, root, "orders", v)[1] for v in (1, 2)}
    found = [(v, again[v], n, written) for v, _, n, written in found]
    return spark.createDataFrame(found, "version int, content_hash string, row_count long, rows_written long")


@query("s19_manifest", _CUT + "SELECT 'orders' AS dataset, content_hash, CAST(n.n AS BIGINT) AS row_count, 'first' AS notes, 'u1' AS created_by FROM root, n")
def manifest(spark, d):
    root, _ = _cut(spark, d, "first")
    stored = store.read_manifest(spark, root, "orders", 1)
    return stored.select("dataset", "content_hash", "row_count", "notes", "created_by")


@query("g09_row_count", f"WITH {R} SELECT status, count(*) AS row_count FROM r WHERE NOT deleted GROUP BY status")
def row_count(spark, d):
    return review_snapshot(spark, d, True).groupBy("status").agg(F.count("*").alias("row_count"))


# --- Version differences ------------------------------------------------

AB = f"a AS ({plain(inputs.V1)}), b AS ({plain(inputs.V2)})"
_MODIFIED = (
    "(a.status <> b.status OR a.priority <> b.priority OR a.total IS DISTINCT FROM b.total OR a.as_of <> b.as_of)"
)


def _pair(spark, d):
    return order_snapshot(spark, d, inputs.V1), order_snapshot(spark, d, inputs.V2)


@query(
    "m15_diff_versions",
    f"""WITH {AB} SELECT coalesce(a.id, b.id) AS id,
    CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change,
    a.status AS old_status, b.status AS new_status,
    CASE WHEN a.id IS NULL OR b.id IS NULL THEN NULL ELSE CAST((a.priority <> b.priority)::INT + (a.total IS DISTINCT FROM b.total)::INT AS BIGINT) END AS n_changes
    FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR {_MODIFIED}""",
)
def diff_versions(spark, d):
    diff = versions.diff_rows(*_pair(spark, d))
    return diff.select("id", "change", "old_status", "new_status", F.size("changes").cast("bigint").alias("n_changes"))


_DIFF_IDS = f"""WITH {AB} SELECT coalesce(a.id, b.id) AS id,
    CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR {_MODIFIED}"""


def cut_pair(spark, d) -> str:
    """A store that holds both versions."""
    root = folder_for(spark, "diff")
    for number, sql in enumerate((inputs.V1, inputs.V2), start=1):
        versions.cut_version(inputs.order_rows(spark, d, sql), inputs.ORDER_CONTRACT, "orders", root, number, "u1", include_unapproved=True)
    return root


@query("m15_diff_stored", _DIFF_IDS)
def diff_stored(spark, d):
    """Two published versions: buckets whose hashes differ are opened, whole rows read only where lines differ."""
    return versions.diff_published(spark, cut_pair(spark, d), "orders", 1, 2).select("id", "change")


@query("j07_match_rows", f"WITH {AB} SELECT coalesce(a.id, b.id) AS id, a.status AS old_status, b.status AS new_status FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status <> b.status")
def match_rows(spark, d):
    a, b = _pair(spark, d)
    both = a.select("id", F.col("status").alias("old_status")).join(
        b.select("id", F.col("status").alias("new_status")), "id", "full_outer"
    )
    return both.filter(~F.col("old_status").eqNullSafe(F.col("new_status")))


@query("j08_added_removed", f"WITH {AB} SELECT id, 'added' AS side FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, 'removed' FROM a WHERE id NOT IN (SELECT id FROM b)")
def added_removed(spark, d):
    a, b = _pair(spark, d)
    added = versions.added_rows(a, b).select("id", F.lit("added").alias("side"))
    return added.unionByName(versions.removed_rows(a, b).select("id", F.lit("removed").alias("side")))


_FIELDS = f"""SELECT a.id, 'priority' AS field, concat('"', a.priority, '"') AS old, concat('"', b.priority, '"') AS new
 FROM a JOIN b ON a.id = b.id WHERE a.priority <> b.priority
 UNION ALL SELECT a.id, 'total', {MONEY.format('a.total')}, {MONEY.format('b.total')}
 FROM a JOIN b ON a.id = b.id WHERE a.total IS DISTINCT FROM b.total"""


@query("j09_field_changes", f"WITH {AB} {_FIELDS}")
def field_changes(spark, d):
    return versions.field_changes(versions.diff_rows(*_pair(spark, d)))


@query(
    "l05_diff_order",
    f"""WITH {AB}, f AS ({_FIELDS}), g AS (SELECT id, string_agg(field, ',' ORDER BY field) AS fields FROM f GROUP BY id), i AS ({_DIFF_IDS.replace("WITH " + AB, "")})
    SELECT i.change, i.id, CASE WHEN i.change = 'modified' THEN coalesce(g.fields, '') END AS fields FROM i LEFT JOIN g ON i.id = g.id""",
)
def diff_order(spark, d):
    diff = versions.in_diff_order(versions.diff_rows(*_pair(spark, d)))
    return diff.select("change", "id", F.array_join("changes.field", ",").alias("fields"))


@query("u06_field_union", f"""WITH {AB} SELECT a.id, CASE WHEN a.total IS NULL AND b.total IS NULL THEN 'as_of,priority' ELSE 'as_of,priority,total' END AS fields
 FROM a JOIN b ON a.id = b.id""")
def field_union(spark, d):
    a, b = _pair(spark, d)
    both = a.select("id", F.col("data").alias("x")).join(b.select("id", F.col("data").alias("y")), "id")
    names = F.array_sort(F.array_union(F.map_keys("x"), F.map_keys("y")))
    return both.select("id", F.array_join(names, ",").alias("fields"))


@query("v16_snapshot_document", f"""WITH {R} SELECT id, 'body' AS "column", 'does not fit long_text' AS reason FROM r WHERE NOT deleted AND body = ''
 UNION ALL SELECT id, 'lang', 'does not fit select' FROM r WHERE NOT deleted AND lang NOT IN ('en', 'de', 'fr', '')
 UNION ALL SELECT id, 'source', 'not in the contract' FROM r WHERE NOT deleted""")
def snapshot_document(spark, d):
    """Rows checked against a narrower contract document."""
    from rowsmith.contract import Contract

    narrow = Contract(tuple(f for f in inputs.REVIEW_CONTRACT.fields if f.key != "source"))
    snap = review_snapshot(spark, d, True)
    return importing.report(snap, "id", errors=checks.document_errors(F.col("data"), narrow))


# --- Versions and datasets ----------------------------------------------

VER = f"v AS ({plain(inputs.VERSIONS)})"
EACH = f"v AS ({plain(inputs.ALL_VERSIONS)})"
DS = f"d AS ({plain(inputs.DATASETS)})"
USR = f"u AS ({plain(inputs.USERS)})"


def _versions(spark, d):
    return load(spark, d, inputs.VERSIONS)


def _all_versions(spark, d):
    return load(spark, d, inputs.ALL_VERSIONS)


def _datasets(spark, d):
    return load(spark, d, inputs.DATASETS)


def _users(spark, d):
    return load(spark, d, inputs.USERS)


@query("g02_next_version", f"WITH {VER}, {DS} SELECT d.dataset, CAST(coalesce(max(v.version), 0) + 1 AS INT) AS next_version FROM d LEFT JOIN v ON d.dataset = v.dataset GROUP BY d.dataset")
def next_version(spark, d):
    return versions.next_versions(_datasets(spark, d), _versions(spark, d))


@query("g03_versions_per_dataset", f"WITH {EACH} SELECT dataset, count(*) AS n_versions FROM v GROUP BY dataset")
def versions_per_dataset(spark, d):
    return catalog.versions_per_dataset(_all_versions(spark, d))


@query("w03_latest_version", f"WITH {EACH} SELECT dataset, version, created_by FROM v QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY version DESC) = 1")
def latest_version(spark, d):
    return versions.latest_versions(_all_versions(spark, d))


@query("l03_versions_newest_first", f"WITH {EACH}, {USR} SELECT dataset, version, created_by FROM v")
def versions_newest_first(spark, d):
    return _all_versions(spark, d).orderBy("dataset", F.desc("version"))


@query("j10_versions_with_creator", f"WITH {EACH}, {USR} SELECT v.dataset, v.version, v.created_by, u.email AS creator_email FROM v LEFT JOIN u ON v.created_by = u.id")
def versions_with_creator(spark, d):
    return catalog.versions_with_creator(_all_versions(spark, d), _users(spark, d))


@query("j13_datasets_with_latest", f"WITH {VER}, {DS} SELECT d.dataset, d.name, d.feature_id, max(v.version) AS latest_version FROM d LEFT JOIN v ON d.dataset = v.dataset GROUP BY ALL")
def datasets_with_latest(spark, d):
    return catalog.with_latest_version(_datasets(spark, d), _versions(spark, d))


@query("j14_deletable_datasets", f"WITH {VER}, {DS} SELECT dataset, name FROM d WHERE dataset NOT IN (SELECT dataset FROM v)")
def deletable_datasets(spark, d):
    return catalog.deletable(_datasets(spark, d), _versions(spark, d)).select("dataset", "name")


@query("j15_cascade_delete", f"WITH {VER}, {DS}, gone AS (SELECT dataset FROM d WHERE dataset NOT IN (SELECT dataset FROM v)) SELECT o_orderkey, concat('cust-', o_custkey) AS dataset FROM orders WHERE concat('cust-', o_custkey) NOT IN (SELECT dataset FROM gone)")
def cascade_delete(spark, d):
    removed = catalog.deletable(_datasets(spark, d), _versions(spark, d))
    child = inputs.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("cust-"), F.col("o_custkey")).alias("dataset"))
    return catalog.cascade(child, removed, "dataset").select("o_orderkey", "dataset")


@query(
    "j15_cascade_levels",
    f"""WITH {VER}, {DS}, gone AS (SELECT dataset FROM d WHERE dataset NOT IN (SELECT dataset FROM v)),
    kept AS (SELECT o_orderkey FROM orders WHERE concat('cust-', o_custkey) NOT IN (SELECT dataset FROM gone))
    SELECT 'datasets' AS tab, count(*) AS n, CAST(0 AS HUGEINT)::BIGINT AS checksum FROM d WHERE dataset NOT IN (SELECT dataset FROM gone)
    UNION ALL SELECT 'rows', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM kept
    UNION ALL SELECT 'edits', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM kept)
    UNION ALL SELECT 'comments', count(*), CAST(sum(event_id) AS BIGINT) FROM events WHERE user_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM kept))""",
)
def cascade_levels(spark, d):
    """Datasets go with their rows, and those with their edits and comments."""
    removed = catalog.deletable(_datasets(spark, d), _versions(spark, d)).select(F.col("dataset").alias("id"))
    tables = {
        "datasets": _datasets(spark, d),
        "rows": inputs.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("cust-"), F.col("o_custkey")).alias("dataset")),
        "edits": inputs.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"),
        "comments": inputs.table(spark, d, "events").select("event_id", "user_id"),
    }
    relations = [
        catalog.Relation("datasets", "rows", "dataset", "dataset"),
        catalog.Relation("rows", "edits", "l_orderkey", "o_orderkey"),
        catalog.Relation("rows", "comments", "user_id", "o_orderkey"),
    ]
    left = catalog.cascade_all(tables, relations, "datasets", removed)
    sums = {"datasets": F.lit(0), "rows": F.col("o_orderkey"), "edits": F.col("l_orderkey"), "comments": F.col("event_id")}
    parts = [left[t].agg(F.count("*").alias("n"), F.sum(v).cast("long").alias("checksum")).select(F.lit(t).alias("tab"), "n", "checksum") for t, v in sums.items()]
    return reduce(DataFrame.unionByName, parts)


@query("f07_datasets_by_feature", f"WITH {DS} SELECT dataset, name, feature_id FROM d WHERE feature_id = 'BUILDING'")
def datasets_by_feature(spark, d):
    return catalog.datasets_by(_datasets(spark, d), feature="BUILDING")


def _pin_tree(name: str, lines: str) -> str:
    """The grouped tree of ``lines`` as ``name(dataset, h)``."""
    return f"""{name}l AS (SELECT dataset, sha256(line) AS h, created_seq, id FROM {lines}),
 {name}6 AS (SELECT dataset, substr(h, 1, 6) AS p, sha256(string_agg(h, '' ORDER BY created_seq, id)) AS h FROM {name}l GROUP BY 1, 2),
 {name}4 AS (SELECT dataset, substr(p, 1, 4) AS p, sha256(string_agg(p || h, '' ORDER BY p)) AS h FROM {name}6 GROUP BY 1, 2),
 {name}2 AS (SELECT dataset, substr(p, 1, 2) AS p, sha256(string_agg(p || h, '' ORDER BY p)) AS h FROM {name}4 GROUP BY 1, 2),
 {name} AS (SELECT dataset, 'sha256:' || sha256(string_agg(p || h, '' ORDER BY p)) AS h FROM {name}2 GROUP BY 1)"""


_PIN_LINES = """SELECT concat('cust-', o_custkey) AS dataset, o_orderkey AS created_seq, concat('ord-', o_orderkey) AS id,
  concat('{{"id":"ord-', o_orderkey, '","status":"', {status}, '"}}') AS line FROM orders WHERE {where}"""
_PINS = f"""WITH old AS ({_PIN_LINES.format(status="o_orderstatus", where="true")}),
 new AS ({_PIN_LINES.format(status="CASE WHEN o_orderkey % 50 = 3 THEN 'X' ELSE o_orderstatus END", where="o_custkey % 7 <> 2")}),
 {_pin_tree("pin", "old")}, {_pin_tree("now", "new")}
SELECT pin.dataset, 1 AS version,
 CASE WHEN now.h IS NULL THEN 'not_found' WHEN now.h = pin.h THEN 'ok' ELSE 'mismatch' END AS outcome, now.h AS actual_hash
FROM pin LEFT JOIN now ON now.dataset = pin.dataset"""


@query("j16_check_pins", _PINS)
def check_pins(spark, d):
    """Pins stored by an earlier cut of every dataset; then orders change and datasets go."""

    def hashes(orders: DataFrame) -> DataFrame:
        snap = orders.select(
            F.concat(F.lit("cust-"), F.col("o_custkey")).alias("dataset"),
            F.timestamp_micros("o_orderkey").alias("created_at"),
            F.concat(F.lit("ord-"), F.col("o_orderkey")).alias("id"),
            F.concat(F.lit('{"id":"ord-'), F.col("o_orderkey"), F.lit('","status":"'), F.col("o_orderstatus"), F.lit('"}')).alias("line"),
        )
        return versions.tree_hash(snap, ("dataset",)).withColumn("version", F.lit(1))

    orders = inputs.table(spark, d, "orders")
    pins = durable.written(hashes(orders).select("dataset", "version", "content_hash"), "pins")
    status = F.when(F.col("o_orderkey") % 50 == 3, "X").otherwise(F.col("o_orderstatus"))
    later = orders.filter(F.col("o_custkey") % 7 != 2).withColumn("o_orderstatus", status)
    return versions.check_pins(pins, hashes(later)).select("dataset", "version", "outcome", "actual_hash")
