"""Registered queries: ranking and classification metrics, candidate ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqbraid.functions.losses import multiclass_focal
from seqbraid.operators import metrics as mt
from seqbraid.operators import ranking as rk
from seqbraid.operators.models import mean_embeddings
from seqbraid.plans.q_slices import ONE_HOP_SQL, slices
from seqbraid.plans.registry import query
from seqbraid.plans.views import GRAPH_SQL, graph, oracle, read
from seqbraid.session import materialise

SCORED_SQL = """
sc as (select cast(l_suppkey % 5 as integer) as g, case when l_returnflag = 'R' then 1 else 0 end as y,
         l_discount * 10 as p from lineitem)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a scored row with many tied scores, in five groups."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 5).cast("int").alias("g"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") * 10).alias("p"),
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def ladder_sql(rows: str, group: str) -> str:
    """AUROC, AUPRC and the like of a table (group, y, p) from distinct scores."""
    return f"""
st as (select {group}, p, count(*) as n, cast(sum(y) as bigint) as pos, sum(pow(p - y, 2)) as sq
       from {rows} group by {group}, p),
ld as (select *, cast(sum(pos) over w as bigint) as tp, cast(sum(n) over w as bigint) as seen,
         cast(sum(pos) over (partition by {group}) as bigint) as tpos
       from st window w as (partition by {group} order by p desc rows unbounded preceding)),
rm as (
  select {group}, cast(sum(n) as bigint) as n, sum(pos) / sum(n) as pos_frac, sum(sq) / sum(n) as brier,
    case when sum(pos) > 0 and sum(pos) < sum(n) then
      sum((n - pos) * (tp - pos + pos / 2.0)) / (sum(pos) * (sum(n) - sum(pos))) end as auroc,
    case when sum(pos) > 0 and sum(pos) < sum(n) then sum(pos * tp / cast(seen as double)) / sum(pos) end
      as auprc
  from ld group by {group})"""


BASE = (SCORED_SQL, ladder_sql("sc", "g"))


@query("auroc_grouped", oracle(*BASE, "select g, n, round(auroc, 6) as auroc from rm"))
def auroc_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.ranking_metrics(scored(spark, sf_dir), ["g"]).select(
        "g", "n", F.round("auroc", 6).alias("auroc")
    )


@query("auprc_grouped", oracle(*BASE, "select g, n, round(auprc, 6) as auprc from rm"))
def auprc_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.ranking_metrics(scored(spark, sf_dir), ["g"]).select(
        "g", "n", F.round("auprc", 6).alias("auprc")
    )


@query(
    "brier",
    oracle(*BASE, "select g, n, round(pos_frac, 6) as pos_frac, round(brier, 6) as brier from rm"),
)
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = mt.ranking_metrics(scored(spark, sf_dir), ["g"])
    return _rounded(table.select("g", "n", "pos_frac", "brier"), "pos_frac", "brier")


@query(
    "ranking_pooled",
    oracle(
        SCORED_SQL,
        "one as (select 0 as g, y, p from sc)",
        ladder_sql("one", "g"),
        """select n, round(pos_frac, 6) as pos_frac, round(brier, 6) as brier, round(auroc, 6) as auroc,
             round(auprc, 6) as auprc from rm""",
    ),
)
def ranking_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = mt.ranking_metrics(scored(spark, sf_dir))
    return _rounded(table, "pos_frac", "brier", "auroc", "auprc")


@query(
    "ranking_documents",
    oracle(
        """dc as (select lang as g, quality as y, n_chars / cast((select max(n_chars) from documents) as double) as p
             from labels join documents using (doc_id))""",
        ladder_sql("dc", "g"),
        "select g, n, round(auroc, 6) as auroc, round(auprc, 6) as auprc from rm",
    ),
)
def ranking_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("g"), "n_chars")
    top = docs.agg(F.max("n_chars").alias("top"))
    rows = (
        read(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .join(F.broadcast(top), how="cross")
        .select("g", F.col("quality").alias("y"), (F.col("n_chars") / F.col("top")).alias("p"))
    )
    table = mt.ranking_metrics(rows, ["g"]).select("g", "n", "auroc", "auprc")
    return _rounded(table, "auroc", "auprc")


_F1 = "2.0 * tp / (seen + tpos)"


@query(
    "best_threshold",
    oracle(
        *BASE,
        f"f1 as (select g, p, row_number() over (partition by g order by {_F1} desc, p) as r from ld)",
        "select g, round(p, 6) as threshold from f1 where r = 1",
    ),
)
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.best_threshold(scored(spark, sf_dir), ["g"]), "threshold")


@query(
    "binary_report",
    oracle(
        *BASE,
        """cf as (select g, count(*) filter (p >= 0.45 and y = 1) as tp, count(*) filter (p >= 0.45 and y = 0) as fp,
             count(*) filter (p < 0.45 and y = 1) as fn, count(*) filter (p < 0.45 and y = 0) as tn
           from sc group by g)""",
        """select cf.g, cast(0.45 as double) as threshold,
             round((2.0 * tp / (2 * tp + fp + fn) + 2.0 * tn / (2 * tn + fp + fn)) / 2, 6) as macro_f1,
             round((tp / cast(tp + fn as double) + tn / cast(tn + fp as double)) / 2, 6) as balanced_accuracy,
             round(tp / cast(tp + fp as double), 6) as precision, round(tp / cast(tp + fn as double), 6) as recall,
             n, round(pos_frac, 6) as positive_fraction, round(brier, 6) as brier, round(auroc, 6) as auroc,
             round(auprc, 6) as auprc
           from cf join rm on rm.g = cf.g""",
    ),
)
def binary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = mt.binary_report(scored(spark, sf_dir), 0.45, ["g"])
    return _rounded(table, *[c for c in table.columns if c not in ("g", "threshold", "n")])


# Four classes, of which group 4 sees only two.
CLASSES_SQL = """
mc as (select cast(l_suppkey % 5 as integer) as g,
         cast(case when l_suppkey % 5 = 4 then l_suppkey % 2 else l_suppkey % 4 end as integer) as y,
         cast(case when l_suppkey % 5 = 4 then l_partkey % 2 else l_partkey % 4 end as integer) as pred
       from lineitem),
nm as (select * from (values (0, 'a'), (1, 'b'), (2, 'c'), (3, 'd')) t(y, class_name)),
gc as (select distinct g, nm.* from mc, nm),
pc as (select gc.g, gc.y, class_name,
         count(*) filter (mc.y = gc.y and mc.pred = gc.y) as tp, count(*) filter (mc.y = gc.y) as support,
         count(*) filter (mc.pred = gc.y) as predicted
       from gc join mc on mc.g = gc.g group by gc.g, gc.y, class_name),
pf as (select *, case when predicted > 0 then tp / cast(predicted as double) else 0 end as prec,
         case when support > 0 then tp / cast(support as double) else 0 end as rec,
         case when predicted + support > 0 then 2.0 * tp / (predicted + support) else 0 end as f1 from pc)"""
NAMES = ["a", "b", "c", "d"]


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = F.col("l_suppkey") % 5 == 4
    label = F.when(narrow, F.col("l_suppkey") % 2).otherwise(F.col("l_suppkey") % 4)
    pred = F.when(narrow, F.col("l_partkey") % 2).otherwise(F.col("l_partkey") % 4)
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 5).cast("int").alias("g"),
        label.cast("int").alias("y"),
        pred.cast("int").alias("pred"),
    )


@query(
    "multiclass_report",
    oracle(
        CLASSES_SQL,
        """select g, y, class_name, round(prec, 6) as precision, round(rec, 6) as recall,
             round(f1, 6) as f1, support, predicted + support > 0 as present from pf""",
    ),
)
def multiclass_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = mt.class_report(classified(spark, sf_dir), NAMES, ["g"])
    return _rounded(table, "precision", "recall", "f1")


@query(
    "confusion",
    oracle(
        CLASSES_SQL,
        """select nm.y, count(*) filter (pred = 0) as pred_0, count(*) filter (pred = 1) as pred_1,
             count(*) filter (pred = 2) as pred_2, count(*) filter (pred = 3) as pred_3
           from nm left join mc on mc.y = nm.y group by nm.y""",
    ),
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion_matrix(classified(spark, sf_dir), 4)


def _macro_sql(mean: str) -> str:
    return oracle(
        CLASSES_SQL,
        f"""select g, cast(sum(support) as bigint) as n, round({mean}, 6) as macro_f1,
              round(sum(f1 * support) / sum(support), 6) as weighted_f1 from pf group by g""",
    )


@query("per_chrom_f1", _macro_sql("avg(f1)"))
def per_chrom_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mt.class_report(classified(spark, sf_dir), NAMES, ["g"])
    return _rounded(mt.macro_f1(report, ["g"]), "macro_f1", "weighted_f1")


@query("per_chrom_f1_present", _macro_sql("avg(f1) filter (predicted + support > 0)"))
def per_chrom_f1_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mt.class_report(classified(spark, sf_dir), NAMES, ["g"])
    return _rounded(mt.macro_f1(report, ["g"], True), "macro_f1", "weighted_f1")


# Links of one-hop slices as scored edges: some slices have one class or few rows.
EDGE_SQL = """
se as (select slice_id, u, v, case when link_id % 7 < 3 then 1 else 0 end as y,
         ((link_id * 37) % 101) / 101.0 as p from sk)"""


def _scores(edges: DataFrame) -> DataFrame:
    link = F.col("link_id")
    return edges.select(
        "slice_id",
        "u",
        "v",
        F.when(link % 7 < 3, 1).otherwise(0).alias("y"),
        ((link * 37) % 101 / 101.0).alias("p"),
    )


def scored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(slices(spark, sf_dir, "1hop").edges)


_aucs: dict[tuple[str, str], DataFrame] = {}


def slice_aucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AUROC of every one-hop slice, a row each; the edges are read once and not written."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _aucs:
        _aucs[key] = materialise(mt.slice_auc(_scores(slices(spark, sf_dir, "1hop").found_edges())))
    return _aucs[key]


_SLICE_BASE = (GRAPH_SQL, ONE_HOP_SQL, EDGE_SQL, ladder_sql("se", "slice_id"))


@query(
    "slice_auc_mean",
    oracle(
        *_SLICE_BASE,
        """select count(*) as n_slices, round(coalesce(avg(coalesce(auroc, 0.5)), 0.5), 6) as mean_auc
           from rm where n >= 4""",
    ),
)
def slice_auc_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.mean_slice_auc(slice_aucs(spark, sf_dir)), "mean_auc")


@query(
    "slice_metrics",
    oracle(
        *_SLICE_BASE,
        """select rm.slice_id, n, round(pos_frac, 6) as pos_frac, round(brier, 6) as brier,
             round(auroc, 6) as auroc, round(auprc, 6) as auprc, target_sn, '1hop' as closure
           from rm join win on win.slice_id = rm.slice_id""",
    ),
)
def slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = slices(spark, sf_dir, "1hop").windows
    per_slice, _, _ = mt.link_evaluation(scored_edges(spark, sf_dir), manifest)
    return _rounded(per_slice, "pos_frac", "brier", "auroc", "auprc")


@query(
    "target_rollup",
    oracle(
        *_SLICE_BASE,
        """select target_sn, '1hop' as closure, count(*) as n_slices, cast(sum(n) as bigint) as n_edges,
             round(avg(auroc), 6) as mean_auroc, round(avg(auprc), 6) as mean_auprc,
             round(avg(brier), 6) as mean_brier
           from rm join win on win.slice_id = rm.slice_id group by target_sn""",
    ),
)
def target_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = slices(spark, sf_dir, "1hop").windows
    _, _, by_target = mt.link_evaluation(scored_edges(spark, sf_dir), manifest)
    return _rounded(by_target, "mean_auroc", "mean_auprc", "mean_brier")


_SPLIT_SQL = """
sa as (select case when target_sn like '%chr2' or target_sn like '%chr5' then 'test' else 'train' end as split,
         '1hop' as closure, coalesce(auroc, 0.5) as auc, target_sn
       from rm join win on win.slice_id = rm.slice_id where n >= 4)"""


def _split_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = slices(spark, sf_dir, "1hop").windows.select("slice_id", "target_sn", "closure")
    test = F.col("target_sn").endswith("chr2") | F.col("target_sn").endswith("chr5")
    joined = slice_aucs(spark, sf_dir).join(windows, "slice_id")
    return joined.withColumn("split", F.when(test, "test").otherwise("train"))


@query(
    "split_summary",
    oracle(
        *_SLICE_BASE,
        _SPLIT_SQL,
        """select split, closure, round(avg(auc), 6) as mean_auc, count(*) filter (auc > 0.5) as n_above_half,
             count(*) as n_slices from sa group by split, closure""",
    ),
)
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.split_summary(_split_auc(spark, sf_dir)), "mean_auc")


@query(
    "chrom_means",
    oracle(
        *_SLICE_BASE,
        _SPLIT_SQL,
        """select split, target_sn, count(*) as n_slices, round(avg(auc), 6) as mean_auc
           from sa group by split, target_sn""",
    ),
)
def chrom_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = mt.group_means(_split_auc(spark, sf_dir), ["split", "target_sn"], "auc")
    return _rounded(table, "mean_auc")


_LOSS_SQL = """
pw as (select g, count(*) filter (y = 0) / cast(greatest(count(*) filter (y = 1), 1) as double) as w
       from sc group by g),
lt as (select sc.g, y, p, w, least(greatest(p, 1e-7), 1 - 1e-7) as c from sc join pw on pw.g = sc.g),
ls as (select g, w, case when y = 1 then c else 1 - c end as pt,
         case when y = 1 then 0.25 * w else 0.75 end as a,
         case when y = 1 then -w * greatest(-100, case when p > 0 then ln(p) else -100 end)
              else -greatest(-100, case when p < 1 then ln(1 - p) else -100 end) end as bce from lt)"""


@query(
    "focal_loss",
    oracle(
        SCORED_SQL,
        _LOSS_SQL,
        "select g, round(avg(-a * pow(1 - pt, 2.0) * ln(pt)), 6) as focal_loss from ls group by g",
    ),
)
def focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.loss_summary(scored(spark, sf_dir), ["g"]).select("g", "focal_loss"), "focal_loss")


@query(
    "weighted_logloss",
    oracle(
        SCORED_SQL,
        _LOSS_SQL,
        """select g, count(*) as n, round(max(w), 6) as pos_weight, round(avg(bce), 6) as weighted_logloss
           from ls group by g""",
    ),
)
def weighted_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = mt.loss_summary(scored(spark, sf_dir), ["g"]).drop("focal_loss")
    return _rounded(table, "pos_weight", "weighted_logloss")


@query(
    "multiclass_focal",
    """with x as (select vec_id, label, cast(unnest(embedding) as double) as z,
                    generate_subscripts(embedding, 1) - 1 as p from embeddings),
        lg as (select * from x),
        ag as (select vec_id, label, ln(sum(exp(z))) as lse, avg(z) as mz,
                 sum(z) filter (p = label) as zt from lg group by vec_id, label),
        tl as (select label, zt - lse as lt, lse - mz as sm, 0.5 + 0.1 * label as w from ag)
       select label, count(*) as n, round(avg(w * pow(greatest(1e-7, 1 - exp(lt)), 2.0)
                * (0.9 * -lt + 0.1 * sm)), 6) as loss
       from tl group by label""",
)
def multiclass_focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.col("embedding").cast("array<double>")
    weights = [0.5 + 0.1 * i for i in range(64)]
    loss = multiclass_focal(logits, F.col("label"), 2.0, weights, 0.1)
    table = read(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.count("*").alias("n"), F.avg(loss).alias("loss")
    )
    return _rounded(table, "loss")


@query(
    "embedding_mean",
    """with x as (select vec_id // 2 as segid, cast(unnest(embedding) as double) as z,
                    generate_subscripts(embedding, 1) - 1 as p from embeddings)
       select segid, cast(p as integer) as pos, round(avg(z), 4) as value, count(*) as n
       from x group by segid, p""",
)
def embedding_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("oid"), F.col("embedding").cast("array<double>").alias("x")
    )
    means = mean_embeddings(vectors).select("segid", "n", F.posexplode("embedding").alias("pos", "value"))
    return means.withColumn("value", F.round("value", 4))


CANDIDATE_SQL = """
cmp as (select distinct from_seg, from_orient, to_seg, to_orient from lk
        where cast(substr(from_seg, 2) as bigint) % 5 <> 0),
cd as (select se.slice_id, se.u, se.v, se.p, se.y as old_label, a.name as u_seg, b.name as v_seg,
         case when se.u % 2 = 0 then '+' else '-' end as u_orient,
         case when se.v % 2 = 0 then '+' else '-' end as v_orient
       from se join seg_u a on a.segid = se.u // 2 join seg_u b on b.segid = se.v // 2 where se.y = 0),
cx as (select cd.*, cmp.from_seg is not null as present_in_comparison from cd
       left join cmp on cmp.from_seg = u_seg and cmp.from_orient = u_orient and cmp.to_seg = v_seg
         and cmp.to_orient = v_orient)"""
_CANDIDATE_BASE = (GRAPH_SQL, ONE_HOP_SQL, EDGE_SQL, CANDIDATE_SQL)


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = graph(spark, sf_dir).links
    return rk.comparison_edges(links.filter("cast(substr(from_seg, 2) as bigint) % 5 <> 0"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = graph(spark, sf_dir).segments
    return rk.candidates(scored_edges(spark, sf_dir), segments, 0, _comparison(spark, sf_dir))


@query("candidates", oracle(*_CANDIDATE_BASE, "select * replace (round(p, 6) as p) from cx"))
def all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(candidates(spark, sf_dir), "p")


@query(
    "topk_candidates",
    oracle(
        *_CANDIDATE_BASE,
        "select * replace (round(p, 6) as p) from (select * from cx order by p desc, slice_id, u, v limit 1000)",
    ),
)
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The edges are read once, to find the best.
    scored = _scores(slices(spark, sf_dir, "1hop").found_edges())
    segments = graph(spark, sf_dir).segments
    return _rounded(rk.best_candidates(scored, segments, 0, _comparison(spark, sf_dir), 1000), "p")


@query(
    "precision_at_k",
    oracle(
        *_CANDIDATE_BASE,
        """rn as (select *, row_number() over (order by p desc, slice_id, u, v) - 1 as r from cx)""",
        """select cast(k as integer) as k, count(*) as n_used,
             round(avg(case when present_in_comparison then 1.0 else 0.0 end), 6) as precision
           from rn, (values (10), (50), (100), (500), (1000)) c(k) where r < k group by k
           union all select null, count(*), round(avg(case when present_in_comparison then 1.0 else 0.0 end), 6)
           from rn""",
    ),
)
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rk.precision_at_k(candidates(spark, sf_dir)), "precision")
