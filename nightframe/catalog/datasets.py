"""Dataset-building queries (DST-01 .. DST-18, JON-03, JON-10, JON-12, SET-02, SET-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe.catalog.base import big, query, r6
from nightframe.catalog.views import PREDS, RECS, epochs, feature_array, predictions, recordings
from nightframe.functions.stages import four_class
from nightframe.operators import dataset as ds
from nightframe.operators import evaluation as ev
from nightframe.operators import relations as rel
from nightframe.plans import dataset_build as build
from nightframe.schema import FEATURES

REC = ["tenant_id", "recording_id"]
IDS = ["recording_id", "epoch_index"]


def labelled(spark, sf):
    df = ds.select_label(predictions(spark, sf))
    return df.withColumn("label", four_class(F.col("label")))


LAB = PREDS + ", lab_v AS (SELECT *, true4 AS label FROM preds_v WHERE true4 IS NOT NULL)"
_MD5 = "md5('42:' || recording_id || ':' || epoch_index)"


def cut_sql(pos: str, n: str, ratios=ds.BUILD_RATIOS) -> str:
    test, val = f"round_even({n} * {ratios.test}, 0)", f"round_even({n} * {ratios.val}, 0)"
    return f"CASE WHEN {pos} < {n} - {test} - {val} THEN 'train' WHEN {pos} < {n} - {test} THEN 'val' ELSE 'test' END"


@query(
    "dst_01_select_label",
    f"""WITH {PREDS} SELECT recording_id, epoch_index, coalesce(ground_truth_stage, predicted_stage) AS label,
  CASE WHEN ground_truth_stage IS NULL THEN 'predicted' ELSE 'ground_truth' END AS label_source FROM preds_v""",
)
def select_label(spark, sf):
    out = ds.select_label(predictions(spark, sf), "ground_truth_or_predicted", allow_predicted=True)
    return out.select(*IDS, "label", "label_source")


@query(
    "dst_02_undersample",
    f"""WITH {LAB}, r AS (SELECT recording_id, epoch_index, label, row_number() OVER (PARTITION BY label ORDER BY {_MD5}, recording_id, epoch_index) AS rn FROM lab_v),
c AS (SELECT min(n) AS t FROM (SELECT count(*) AS n FROM lab_v GROUP BY label))
SELECT recording_id, epoch_index, label FROM r, c WHERE rn <= t""",
)
def undersample(spark, sf):
    return ds.balance_classes(labelled(spark, sf), "label", IDS, "undersample").select(*IDS, "label")


@query(
    "dst_02_oversample",
    f"""WITH {LAB}, r AS (SELECT recording_id, epoch_index, label, row_number() OVER (PARTITION BY label ORDER BY {_MD5}, recording_id, epoch_index) - 1 AS pos FROM lab_v),
c AS (SELECT label, count(*) AS n FROM lab_v GROUP BY label), t AS (SELECT max(n) AS t FROM c),
d AS (SELECT label, n, unnest(range(t)) AS draw FROM c, t),
p AS (SELECT label, draw, CAST(('0x' || substr(md5('42:' || label || ':' || draw), 1, 12)) AS BIGINT) % n AS pos FROM d)
SELECT p.label, p.draw, r.recording_id, r.epoch_index FROM p JOIN r ON p.label = r.label AND p.pos = r.pos""",
)
def oversample(spark, sf):
    return ds.balance_classes(labelled(spark, sf), "label", IDS, "oversample").select("label", "draw", *IDS)


@query(
    "dst_03_stratified_split",
    f"""WITH {LAB}, r AS (SELECT recording_id, epoch_index, row_number() OVER (PARTITION BY label ORDER BY {_MD5}, recording_id, epoch_index) - 1 AS pos,
  count(*) OVER (PARTITION BY label) AS n FROM lab_v) SELECT recording_id, epoch_index, {cut_sql('pos', 'n')} AS split FROM r""",
)
def stratified(spark, sf):
    return ds.stratified_split(labelled(spark, sf), "label", IDS).select(*IDS, "split")


def group_sql(order: str) -> str:
    return f"""g AS (SELECT recording_id, min(end_sec) AS st, min(dataset_id) AS dsid, avg(CASE WHEN label = 'REM' THEN 1.0 ELSE 0 END) AS rem FROM lab_v GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n FROM g),
sp AS (SELECT recording_id, {cut_sql('pos', 'n')} AS split FROM o)"""


SEEDED = group_sql("md5('42:' || recording_id), recording_id")


@query("dst_04_grouped_split", f"WITH {LAB}, {SEEDED} SELECT recording_id, split FROM sp")
def grouped(spark, sf):
    return ds.grouped_split(labelled(spark, sf), ["recording_id"]).select("recording_id", "split").distinct()


@query(
    "dst_04_time_ordered_split",
    f"WITH {LAB}, {group_sql('st, recording_id')} SELECT recording_id, split FROM sp",
)
def time_ordered(spark, sf):
    out = ds.grouped_split(labelled(spark, sf), ["recording_id"], by_time=True)
    return out.select("recording_id", "split").distinct()


@query(
    "dst_05_time_overlap_split",
    f"""WITH {RECS}, t AS (SELECT recording_id, recording_id * 2000 + 1 AS s, recording_id * 2000 + n_epochs * 30 AS e FROM recs_v),
q AS (SELECT *, max(e) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t),
k AS (SELECT recording_id, s, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (ORDER BY s) AS grp FROM q),
g AS (SELECT grp, min(s) AS st FROM k GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY st, grp) - 1 AS pos, count(*) OVER () AS n FROM g)
SELECT recording_id, {cut_sql('pos', 'n')} AS split FROM k JOIN o USING (grp)""",
)
def time_overlap(spark, sf):
    recs = recordings(spark, sf).select(
        "recording_id", "dataset_id", (F.col("recording_id") * 2000 + 1).alias("s"),
        (F.col("recording_id") * 2000 + F.col("n_epochs") * 30).alias("e"), F.lit("W").alias("label"),
    )
    groups = rel.overlap_groups(recs, "recording_id", "s", "e")
    return ds.grouped_split(groups, ["time_group"], "s", by_time=True).select("recording_id", "split")


@query(
    "dst_06_time_blocks",
    f"""WITH RECURSIVE {LAB}, p AS (SELECT recording_id, epoch_index, end_sec, row_number() OVER (PARTITION BY recording_id ORDER BY epoch_index) AS rn FROM lab_v),
w AS (SELECT recording_id, epoch_index, rn, end_sec, end_sec AS bs FROM p WHERE rn = 1
  UNION ALL SELECT p.recording_id, p.epoch_index, p.rn, p.end_sec, CASE WHEN p.end_sec - w.bs > 600 THEN p.end_sec ELSE w.bs END FROM w JOIN p ON p.recording_id = w.recording_id AND p.rn = w.rn + 1)
SELECT recording_id, epoch_index, bs AS block_start FROM w""",
)
def time_blocks(spark, sf):
    return ds.time_blocks(labelled(spark, sf), REC, "end_sec", 600).select(*IDS, "block_start")


_HALVES = "CASE WHEN (epoch_index // 20) % 3 = 0 THEN 'test' ELSE 'train' END"


def halves(df):
    return df.withColumn("split", F.when(F.floor(F.col("epoch_index") / 20) % 3 == 0, "test").otherwise("train"))


@query(
    "dst_07_purge_gap",
    f"""WITH {LAB}, s AS (SELECT recording_id, epoch_index, {_HALVES} AS split, row_number() OVER (PARTITION BY recording_id ORDER BY epoch_index) AS pos FROM lab_v),
e AS (SELECT *, coalesce(split <> lag(split) OVER (PARTITION BY recording_id ORDER BY pos), false) AS edge FROM s),
d AS (SELECT *, max(CASE WHEN edge THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS near FROM e)
SELECT recording_id, epoch_index, split FROM d WHERE near = 0""",
)
def purge(spark, sf):
    return ds.purge_gap(halves(labelled(spark, sf)), REC, 3).select(*IDS, "split")


_STRATA = f"""g AS (SELECT recording_id, min(dataset_id) AS dsid, avg(CASE WHEN label = 'REM' THEN 1.0 ELSE 0 END) AS rem FROM lab_v GROUP BY 1),
s AS (SELECT *, dsid || ':' || CASE WHEN rem < 0.15 THEN 'low' WHEN rem < 0.30 THEN 'mid' ELSE 'high' END AS stratum FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || recording_id), recording_id) AS rk FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY rk, stratum) - 1 AS pos, count(*) OVER () AS n FROM r)"""


@query(
    "dst_08_grouped_stratification",
    f"WITH {LAB}, {_STRATA} SELECT recording_id, stratum, CAST(pos AS BIGINT) AS \"order\", {cut_sql('pos', 'n')} AS split FROM o",
)
def stratified_groups(spark, sf):
    groups = ds.group_table(labelled(spark, sf), ["recording_id"], "end_sec")
    ordered = ds.order_groups(groups, ["recording_id"], stratify="dataset_rem")
    return ds.assign_groups(ordered).select("recording_id", "stratum", "order", "split")


@query(
    "dst_09_split_integrity",
    f"""WITH {LAB}, s AS (SELECT recording_id, {_HALVES} AS split FROM lab_v)
SELECT recording_id, CAST(count(DISTINCT split) AS INT) AS n_splits, 'test,train' AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def integrity(spark, sf):
    return rel.split_overlap(halves(labelled(spark, sf)), ["recording_id"])


@query(
    "jon_12_shared_windows",
    f"""WITH {LAB}, {SEEDED}, s AS (SELECT recording_id, epoch_index, split FROM lab_v JOIN sp USING (recording_id)
  UNION ALL SELECT recording_id, epoch_index, 'test' FROM lab_v WHERE k % 9 = 0)
SELECT recording_id, epoch_index, CAST(count(DISTINCT split) AS INT) AS n_splits, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM s GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""",
)
def shared_windows(spark, sf):
    df = ds.grouped_split(labelled(spark, sf), ["recording_id"])
    leaked = df.filter(F.col("k") % 9 == 0).withColumn("split", F.lit("test"))
    return rel.split_overlap(df.unionByName(leaked).select(*IDS, "split"), IDS)


@query(
    "set_02_split_intersection",
    f"WITH {LAB}, s AS (SELECT recording_id, {_HALVES} AS split FROM lab_v) SELECT recording_id FROM s WHERE split = 'train' INTERSECT SELECT recording_id FROM s WHERE split = 'test'",
)
def split_intersection(spark, sf):
    return rel.shared_keys(halves(labelled(spark, sf)), ["recording_id"], "train", "test")


@query(
    "set_04_untimed_recordings",
    f"WITH {RECS} SELECT recording_id, CASE WHEN n_epochs < 60 THEN 'own:' || recording_id ELSE 'timed' END AS grp FROM recs_v",
)
def untimed(spark, sf):
    recs = recordings(spark, sf).select(
        "recording_id", F.when(F.col("n_epochs") >= 60, F.col("recording_id") * 2000).alias("s"),
        (F.col("recording_id") * 2000 + F.col("n_epochs") * 30).alias("e"),
    )
    groups = rel.overlap_groups(recs, "recording_id", "s", "e")
    own = F.concat(F.lit("own:"), "recording_id")
    return groups.select("recording_id", F.when(F.col("time_group").isNull(), own).otherwise("timed").alias("grp"))


@query(
    "jon_03_windows_labels",
    f"""WITH {LAB}, w AS (SELECT a.recording_id, a.epoch_index, count(*) AS n FROM epochs_v a JOIN epochs_v b ON a.recording_id = b.recording_id AND b.epoch_index BETWEEN a.epoch_index - 20 AND a.epoch_index GROUP BY 1, 2)
SELECT recording_id, epoch_index, label, n < 21 AS padded FROM w JOIN lab_v USING (recording_id, epoch_index)""",
)
def windows_labels(spark, sf):
    from nightframe.catalog.windows import window_rows

    rows = labelled(spark, sf).select(*REC, "window_end_ts", "label")
    windows = window_rows(spark, sf, "zero_fill", 21)
    return windows.join(rows, [*REC, "window_end_ts"]).select(*IDS, "label", "padded")


def config():
    return build.DatasetConfig(time_aware=True, stratify=None, schema_version="v1")


@query(
    "dst_10_build_metadata",
    f"""WITH {LAB}, w AS (SELECT a.recording_id, a.epoch_index, count(*) AS n FROM epochs_v a JOIN epochs_v b ON a.recording_id = b.recording_id AND b.epoch_index BETWEEN a.epoch_index - 20 AND a.epoch_index GROUP BY 1, 2),
{group_sql('st, recording_id')}, d AS (SELECT l.label, split, n < 21 AS padded FROM lab_v l JOIN sp USING (recording_id) JOIN w USING (recording_id, epoch_index))
SELECT count(*) FILTER (WHERE split = 'train') AS train_windows, count(*) FILTER (WHERE split = 'val') AS val_windows, count(*) FILTER (WHERE split = 'test') AS test_windows,
  count(*) AS ground_truth_labels, 0::BIGINT AS predicted_labels, count(*) FILTER (WHERE padded) AS padded_windows, string_agg(DISTINCT label, ',' ORDER BY label) AS label_map,
  21 AS window_size, 42 AS random_seed, 'recording' AS split_strategy, 20 AS purge_gap FROM d""",
)
def build_metadata(spark, sf):
    eps = epochs(spark, sf).withColumn("features", feature_array()).withColumn("feature_schema_version", F.lit("v1"))
    return build.dataset_metadata(build.build_dataset(eps, predictions(spark, sf), config()), config())


_SNAP = f"""{LAB}, d AS (SELECT recording_id, epoch_index, sha256(recording_id || ':' || strftime(window_end_ts, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || label || chr(10)) AS rd FROM lab_v),
b AS (SELECT recording_id, epoch_index // 2048 AS b, sha256(string_agg(rd, '' ORDER BY epoch_index)) AS bd, count(*) AS n FROM d GROUP BY 1, 2),
t AS (SELECT md5(recording_id || ':' || b) AS p, bd AS d, n FROM b), z AS (SELECT CASE WHEN count(*) <= 16 THEN 0 WHEN count(*) <= 256 THEN 1 WHEN count(*) <= 4096 THEN 2 ELSE 3 END AS z FROM t),
l3 AS (SELECT left(p, 3) AS p, sha256(string_agg(d, '' ORDER BY t.p)) AS d, sum(n) AS n FROM t, z WHERE z = 3 GROUP BY left(t.p, 3)),
{', '.join(f"l{k} AS (SELECT left(q.p, {k}) AS p, sha256(string_agg(q.d, '' ORDER BY q.p)) AS d, sum(n) AS n FROM (SELECT * FROM l{k + 1} UNION ALL SELECT t.* FROM t, z WHERE z = {k}) q GROUP BY left(q.p, {k}))" for k in (2, 1, 0))},
root AS (SELECT d AS checksum, CAST(n AS BIGINT) AS row_count FROM l0)"""


@query("dst_11_snapshot_digest", f"WITH {_SNAP} SELECT * FROM root")
def snapshot(spark, sf):
    return ds.snapshot_digest(ds.snapshot_rows(labelled(spark, sf)))


@query(
    "dst_12_snapshot_verify",
    f"WITH {_SNAP} SELECT checksum AS expected, checksum AS computed, row_count AS expected_rows, row_count AS computed_rows, true AS matches FROM root",
)
def snapshot_verify(spark, sf):
    first = ds.snapshot_digest(ds.snapshot_rows(labelled(spark, sf)))
    again = ds.snapshot_digest(ds.snapshot_rows(labelled(spark, sf).repartition(5)))
    return ds.verify_snapshot(first, again)


@query(
    "dst_12_snapshot_differences",
    f"""WITH {LAB} SELECT recording_id AS recording, CAST(epoch_index // 2048 AS BIGINT) AS block, CASE WHEN recording_id % 40 = 7 THEN 'changed' WHEN recording_id % 40 = 11 THEN 'missing' ELSE 'added' END AS change
FROM lab_v WHERE recording_id % 40 IN (7, 11, 13) GROUP BY ALL HAVING recording_id % 40 <> 7 OR max((epoch_index % 50 = 3)::INT) = 1""",
)
def snapshot_differences(spark, sf):
    """Some rows of a snapshot change, some recordings go or come: the tree names their blocks."""
    rows = labelled(spark, sf)
    group = F.col("recording_id") % 40
    stored = ds.snapshot_rows(rows.filter(group != 13))
    other = F.when((group == 7) & (F.col("epoch_index") % 50 == 3), F.concat(F.col("label"), F.lit("?"))).otherwise(F.col("label"))
    rebuilt = ds.snapshot_rows(rows.filter(group != 11).withColumn("label", other))
    first = ds.snapshot_tree(stored)
    depth = first.agg(F.max("level")).first()[0]
    return ds.tree_differences(first, ds.snapshot_tree(rebuilt, depth=depth)).select("recording", F.col("block").cast("bigint").alias("block"), "change")


@query(
    "dst_13_snapshot_reload",
    f"WITH {LAB}, {SEEDED} SELECT recording_id, epoch_index, label, hr_mean > 45 AS found, split FROM lab_v JOIN sp USING (recording_id)",
)
def snapshot_reload(spark, sf):
    stored = ds.grouped_split(labelled(spark, sf), ["recording_id"]).select(*REC, "epoch_index", "label", "split")
    rebuilt = epochs(spark, sf).filter(F.col("hr_mean") > 45).select(*REC, "epoch_index", "hr_mean")
    return ds.reload_snapshot(stored, rebuilt, [*REC, "epoch_index"]).select(*IDS, "label", "found", "split")


@query(
    "dst_14_split_manifest",
    f"""WITH {LAB}, s AS (SELECT recording_id, {_HALVES} AS split FROM lab_v), m AS (SELECT recording_id, count(DISTINCT split) AS ns FROM s GROUP BY 1)
SELECT split, count(*) AS windows, count(DISTINCT recording_id) AS recordings, bool_or(ns > 1) AS recording_overlap FROM s JOIN m USING (recording_id) GROUP BY 1""",
)
def manifest(spark, sf):
    return ds.split_manifest(halves(labelled(spark, sf))).select("split", big("windows"), big("recordings"), "recording_overlap")


@query(
    "dst_15_ground_truth_rows",
    f"""WITH {PREDS} SELECT recording_id, end_sec, ground_truth_stage AS truth, 1.0::DOUBLE AS p_truth, 0.0::DOUBLE AS p_rest, 1.0::DOUBLE AS truth_confidence, 'ground_truth' AS truth_version
FROM preds_v WHERE ground_truth_stage IS NOT NULL""",
)
def ground_truth(spark, sf):
    out = ds.ground_truth_rows(predictions(spark, sf), "ground_truth_stage")
    total = F.aggregate(F.map_values("truth_probabilities"), F.lit(0.0), lambda a, x: a + x)
    p = F.element_at("truth_probabilities", F.col("truth"))
    return out.select(
        "recording_id", "end_sec", "truth", p.alias("p_truth"), (total - p).alias("p_rest"), "truth_confidence", "truth_version"
    )


@query(
    "dst_16_artifact_contract",
    f"""WITH {RECS}, n AS (SELECT recording_id, count(*) AS nf, count(ground_truth_stage) AS nl, count(*) AS nm, count(*) FILTER (WHERE hr_mean > 45) AS nv FROM preds_v GROUP BY 1)
SELECT recording_id, 'length mismatch' AS problem FROM n WHERE nf <> nl UNION ALL SELECT recording_id, 'timestamps length mismatch' FROM n WHERE nf <> nl
UNION ALL SELECT recording_id, 'mask has no invalid epochs' FROM n WHERE recording_id % 2 = 0 AND nv = nm
UNION ALL SELECT recording_id, 'non-causal feature' FROM n WHERE recording_id % 6 = 0""",
)
def artifact_contract(spark, sf):
    df = predictions(spark, sf)
    nights = df.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_features"), F.count("ground_truth_stage").alias("n_labels"), F.count(F.lit(1)).alias("n_mask"),
        F.count(F.lit(1)).alias("n_timestamps"), F.lit(0).alias("bad_labels"), F.count_if(F.col("hr_mean") > 45).alias("n_valid"),
        F.when(F.col("recording_id") % 2 == 0, "reconciled").otherwise("exact").alias("alignment_status"),
        F.lit("short").alias("alignment_reason"), F.lit(0).alias("failed_required"),
    )
    feats = df.select("recording_id").distinct().select(
        "recording_id", F.explode(F.array(*[F.lit(f) for f in FEATURES])).alias("name")
    ).withColumn("causal", ~((F.col("name") == "drr") & (F.col("recording_id") % 6 == 0)))
    return ds.artifact_problems(nights, feats, ["recording_id"])


@query(
    "dst_17_policy_diff",
    f"""WITH {RECS}, a AS (SELECT recording_id, unnest(['seed', 'split.train', 'split.test']) AS path, unnest(['42', CAST(n_epochs AS VARCHAR), '0.15']) AS value FROM recs_v),
b AS (SELECT recording_id, unnest(['seed', 'split.train', 'split.val']) AS path, unnest(['42', CASE WHEN recording_id % 2 = 0 THEN CAST(n_epochs AS VARCHAR) ELSE 'x' END, '0.1']) AS value FROM recs_v)
SELECT coalesce(a.recording_id, b.recording_id) AS recording_id, coalesce(a.path, b.path) AS path, a.value AS expected, b.value AS actual,
 CASE WHEN b.path IS NULL THEN 'missing key in actual' WHEN a.path IS NULL THEN 'unexpected key in actual' ELSE 'value mismatch' END AS difference
FROM a FULL JOIN b ON a.recording_id = b.recording_id AND a.path = b.path WHERE a.value IS DISTINCT FROM b.value""",
)
def policy_diff(spark, sf):
    recs = recordings(spark, sf)

    def table(entries):
        items = F.array(*[F.struct(F.lit(p).alias("path"), v.cast("string").alias("value")) for p, v in entries])
        return recs.select("recording_id", F.explode(items).alias("x")).select("recording_id", "x.*")

    n = F.col("n_epochs").cast("string")
    a = table([("seed", F.lit("42")), ("split.train", n), ("split.test", F.lit("0.15"))])
    b = table([("seed", F.lit("42")), ("split.train", F.when(F.col("recording_id") % 2 == 0, n).otherwise("x")), ("split.val", F.lit("0.1"))])
    return ds.policy_diff(a, b, ["recording_id"])


@query(
    "dst_18_weighted_resample",
    f"""WITH {LAB}, h AS (SELECT recording_id, epoch_index, k > 80 AS hard, row_number() OVER (PARTITION BY k > 80 ORDER BY {_MD5}, recording_id, epoch_index) - 1 AS pos FROM lab_v),
z AS (SELECT count(*) FILTER (WHERE hard) AS nh, count(*) FILTER (WHERE NOT hard) AS ne, count(*) AS n FROM h),
d AS (SELECT nh, ne, unnest(range(n)) AS draw FROM z),
u AS (SELECT *, CAST(('0x' || substr(md5('42:' || draw), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE * (nh * 3.0::DOUBLE + ne) AS spot FROM d),
p AS (SELECT draw, spot < nh * 3 AS hard, CAST(CASE WHEN spot < nh * 3 THEN least(floor(spot / 3), nh - 1) ELSE least(floor(spot - nh * 3), ne - 1) END AS BIGINT) AS pos FROM u)
SELECT p.draw, h.recording_id, h.epoch_index FROM p JOIN h ON p.hard = h.hard AND p.pos = h.pos""",
)
def resample(spark, sf):
    df = labelled(spark, sf).withColumn("hard", F.col("k") > 80)
    return ds.weighted_resample(df, "hard", IDS, 3.0).select("draw", *IDS)


@query(
    "agg_32_label_sources",
    f"WITH {PREDS} SELECT CASE WHEN ground_truth_stage IS NULL THEN 'predicted' ELSE 'ground_truth' END AS label_source, count(*) AS count FROM preds_v GROUP BY 1",
)
def label_sources(spark, sf):
    out = ds.select_label(predictions(spark, sf), "ground_truth_or_predicted", allow_predicted=True)
    return out.groupBy("label_source").agg(F.count(F.lit(1)).alias("count"))


@query(
    "jon_10_snapshot_windows_join",
    f"""WITH {LAB}, w AS (SELECT recording_id, epoch_index FROM epochs_v WHERE value < 150)
SELECT l.recording_id, l.epoch_index, l.label, w.epoch_index IS NOT NULL AS found FROM lab_v l LEFT JOIN w ON w.recording_id = l.recording_id AND w.epoch_index = l.epoch_index""",
)
def snapshot_join(spark, sf):
    stored = labelled(spark, sf).select(*REC, "window_end_ts", "epoch_index", "label")
    rebuilt = epochs(spark, sf).filter(F.col("value") < 150).select(
        *REC, (F.col("epoch_start_ts") + F.expr("INTERVAL 30 SECONDS")).alias("window_end_ts")
    )
    return ds.reload_snapshot(stored, rebuilt, [*REC, "window_end_ts"]).select(*IDS, "label", "found")
