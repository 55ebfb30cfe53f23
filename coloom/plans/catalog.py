"""Every registered query: name -> function(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coloom.functions import text as X
from coloom.operators import centrality as C
from coloom.operators import colocation as L
from coloom.operators import embedding as E
from coloom.operators import features as FT
from coloom.operators import graph_networks as GN
from coloom.operators import hetero as H
from coloom.operators import inference as I
from coloom.operators import metrics as M
from coloom.operators import models as ML
from coloom.operators import network as N
from coloom.operators import statistics as S
from coloom.operators.components import member_components
from coloom.operators.extract import extract_case_details, extract_cases, extract_events, visits_of
from coloom.operators.neighbors import decayed_sums, decayed_weights, neighbor_sums
from coloom.operators.split import hash_split, hash_splits_by_seed
from coloom.plans import contrast, risk, sweeps
from coloom.plans import graph_models as GM
from coloom.session import checkpoint_folder, cut, size_shuffles
from coloom.sources import sinks
from coloom.sources import tables as T
from coloom.sources.reports import read_case_blocks, read_cases, read_events, split_cases

# Cut-over days on the two calendars of the tables.
CLICK_CUTOVER = dt.date(2024, 1, 16)
SHIP_CUTOVER = dt.date(1998, 6, 1)
SHIP_FESTIVAL = dt.date(1998, 7, 15)

WORDS = {
    "article": ["the ", "The "],
    "link": ["and ", "for "],
    "place": [" on", " in", " at"],
    "mail": ["@"],
    "web": ["http", "www."],
}
CASCADE = [(4, ["http", "@"]), (8, ["license", "License"]), (3, ["thion"]), (2, ["ation"]), (6, ["ing"])]

QUERIES: dict[str, Callable[..., DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals (no negative zero), so equal results compare equal."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), 6) + F.lit(0.0)).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def join_sorted(col: str):
    return F.array_join(F.array_sort(col), "|").alias(col)


# -- statistics ---------------------------------------------------------------


@query
def venue_frequency(spark, sf):
    return S.venue_frequency(T.click_events(spark, sf))


@query
def event_type_share(spark, sf):
    return tidy(S.frequency(T.click_events(spark, sf), "venue"))


@query
def top5_venues_per_province(spark, sf):
    return S.top_items(T.ship_visits(spark, sf), "province", "venue", 5)


@query
def daily_counts(spark, sf):
    return S.daily_counts(T.click_events(spark, sf), CLICK_CUTOVER, "day")


@query
def cutover_coverage(spark, sf):
    return S.coverage(T.click_events(spark, sf), CLICK_CUTOVER, "day")


@query
def province_stats(spark, sf):
    return S.province_stats(extract_case_details(split_cases(T.line_reports(spark, sf))))


@query
def top5_symptoms_per_province(spark, sf):
    details = extract_case_details(split_cases(T.line_reports(spark, sf)))
    return S.top_items(details.select("province", F.explode("symptoms").alias("symptom")), "province", "symptom", 5)


@query
def dataset_stats(spark, sf):
    return tidy(S.dataset_stats(extract_case_details(split_cases(T.line_reports(spark, sf)))))


@query
def extraction_stats(spark, sf):
    blocks = split_cases(T.line_reports(spark, sf))
    return tidy(S.block_stats(blocks))


@query
def event_type_distribution(spark, sf):
    return tidy(S.frequency(extract_events(split_cases(T.line_reports(spark, sf))), "event_type_name"))


# -- text ---------------------------------------------------------------------


@query
def case_blocks(spark, sf):
    return split_cases(T.line_reports(spark, sf)).select(
        "report_id", "case_seq", "case_no", "case_id", F.length("case_text").alias("n_chars")
    )


def _folder(spark):
    """A new folder that all executors share."""
    return f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"


@query
def file_case_blocks(spark, sf):
    """Reports written as text files and read back in splits."""
    size_shuffles(spark, T.table(spark, sf, "lineitem").count())
    folder = _folder(spark)
    T.line_reports(spark, sf).select("content").write.text(folder)
    blocks = read_case_blocks(spark, folder)
    # In a file a block runs on to the opening words of the next report.
    text = F.regexp_replace("case_text", "\\n(通报如下。)?", "")
    return blocks.groupBy("case_no").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length(text)).cast("long").alias("n_chars")
    )


@query
def json_cases(spark, sf):
    """Case records written as JSON and read back."""
    folder = _folder(spark)
    sinks.write_json(extract_cases(split_cases(T.line_reports(spark, sf))), folder)
    return read_cases(spark, folder)


@query
def json_events(spark, sf):
    """Event records written as JSON and read back."""
    folder = _folder(spark)
    sinks.write_json(extract_events(split_cases(T.line_reports(spark, sf))), folder)
    return read_events(spark, folder).groupBy("event_type_name", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).cast("long").alias("n_chars"), F.sum(F.size("venues")).cast("long").alias("n_venues")
    )


@query
def bundle_edges(spark, sf):
    """The graph bundle written and read back: edges of each relation between known nodes, case-case edges too."""
    events, cases = T.ship_events(spark, sf), T.ship_cases(spark, sf)
    nodes = cut(H.node_map(events, cases))
    named = H.item_edges(events, cases).unionByName(H.case_edges(T.ship_visits(spark, sf)))
    folder = _folder(spark)
    sinks.write_graph({"edges": H.indexed_edges(named, nodes), "nodes": nodes}, folder)
    return H.edge_counts(sinks.read_graph(spark, folder)["edges"])


@query
def case_metadata(spark, sf):
    return extract_cases(split_cases(T.line_reports(spark, sf)))


@query
def extracted_events(spark, sf):
    e = extract_events(split_cases(T.line_reports(spark, sf)))
    return e.select(
        "case_id",
        "province",
        "event_type",
        "event_type_name",
        "date",
        join_sorted("venues"),
        join_sorted("transports"),
        join_sorted("symptoms"),
        "sentence",
        "is_lockdown",
    )


@query
def case_details(spark, sf):
    d = extract_case_details(split_cases(T.line_reports(spark, sf)))
    return d.select(
        "province",
        "case_id",
        F.length("text").alias("n_chars"),
        F.size("dates").alias("n_dates"),
        "first_date",
        "last_date",
        join_sorted("venues"),
        join_sorted("symptoms"),
        "is_asymptomatic",
        "wuhan_connection",
        "age",
        "gender",
    )


@query
def document_sentences(spark, sf):
    found = X.sentences(F.col("text"), ".;", 3)
    return T.table(spark, sf, "documents").select("doc_id", F.size(found).alias("n_sentences"))


@query
def document_keyword_classes(spark, sf):
    return T.table(spark, sf, "documents").select(
        "doc_id", F.array_join(X.keyword_classes(F.col("text"), WORDS), "|").alias("classes")
    )


@query
def document_cascade(spark, sf):
    docs = T.table(spark, sf, "documents").select(X.event_type(F.col("text"), CASCADE, 9).alias("event_type"))
    return tidy(S.frequency(docs, "event_type"))


@query
def document_prefixes(spark, sf):
    t = F.col("text")
    return T.table(spark, sf, "documents").select(
        "doc_id",
        F.length(t).alias("chars"),
        F.md5(t).alias("text_md5"),
        X.first_number(t, ["([0-9]{1,6}) ", "([0-9]{1,6})"]).alias("first_number"),
        X.contains_any(t, ["@", "http"]).alias("has_contact"),
    )


@query
def province_labels(spark, sf):
    r = T.line_reports(spark, sf)
    named = F.concat(
        F.element_at(
            F.array(F.lit("北京市"), F.lit("内蒙古自治区"), F.lit("某某省"), F.lit("")),
            (F.length("content") % 4 + 1).cast("int"),
        )
    )
    return r.groupBy(X.province_label(named).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# -- labels -------------------------------------------------------------------


@query
def label_same_day(spark, sf):
    labels = L.cluster_labels(T.ship_visits(spark, sf), [0])
    return L.label_cases(T.ship_cases(spark, sf), labels)


@query
def label_band(spark, sf):
    labels = L.cluster_labels(T.ship_visits(spark, sf), sweeps.WINDOWS)
    return L.label_cases(T.ship_cases(spark, sf), labels)


@query
def label_two_others(spark, sf):
    nodes = T.ship_cases(spark, sf).select(F.col("case_id").alias("node"))
    deg = C.with_nodes(nodes, neighbor_sums(L.members(T.ship_visits(spark, sf), 3)))
    return L.crowd_labels(deg, 2)


@query
def label_window_sweep(spark, sf):
    return tidy(sweeps.label_counts(T.ship_cases(spark, sf), T.ship_visits(spark, sf)))


@query
def edge_window_sweep(spark, sf):
    return sweeps.edge_counts(T.ship_visits(spark, sf))


@query
def decay_sweep(spark, sf):
    return tidy(decayed_weights(T.ship_visits(spark, sf), [3, 5, 7, 14], 3))


@query
def label_distribution(spark, sf):
    labels = L.label_cases(T.ship_cases(spark, sf), L.cluster_labels(T.ship_visits(spark, sf), [0]))
    return tidy(H.label_distribution(labels, "label_0"))


# -- edges --------------------------------------------------------------------


def _hour_slots(spark, sf):
    """Clicks with the hour in the place of the day: people per (kind, hour)."""
    hours = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("int")
    return T.click_events(spark, sf).select("case_id", "venue", F.date_from_unix_date(hours).alias("day"))


@query
def edges_capped_multigraph(spark, sf):
    e = L.edges(L.members(_hour_slots(spark, sf), 0, ["venue"]))
    return e.select("node", "clique.venue", F.col("clique.d").alias("slot"), "n")


@query
def edges_same_day(spark, sf):
    return L.edges(L.members(T.ship_visits(spark, sf), 0)).select("node", "clique.*", "n")


@query
def edges_band_weighted(spark, sf):
    return L.band_edges(T.ship_visits(spark, sf), 3).select("node", "clique.*", "day", "n")


@query
def edges_offset_expanded(spark, sf):
    return L.edges(L.members(T.ship_visits(spark, sf), 6)).select("node", "clique.*", "n")


# The same measures where places are crowded: all customers of a segment in a quarter.


def _crowd(spark, sf):
    return L.members(T.quarter_visits(spark, sf), 0)


@query
def crowd_edge_count(spark, sf):
    return neighbor_sums(_crowd(spark, sf)).agg((F.sum("degree") / 2).cast("long").alias("n_edges"))


@query
def crowd_multi_edge_count(spark, sf):
    return H.case_edge_count(T.quarter_visits(spark, sf)).select("n_edges")


@query
def crowd_degree(spark, sf):
    return neighbor_sums(_crowd(spark, sf)).select("node", "degree")


@query
def crowd_proximity(spark, sf):
    visits = T.quarter_visits(spark, sf)
    days = visits.groupBy(F.col("case_id").alias("node")).agg(L.day_number(F.min("day")).alias("day"))
    return tidy(E.temporal_proximity(_crowd(spark, sf), days, 30.0))


@query
def crowd_gcn(spark, sf):
    return tidy(E.gcn_propagate(_crowd(spark, sf), _values(spark, sf), ["balance", "nation"]))


@query
def crowd_transitivity(spark, sf):
    return tidy(C.transitivity_share(_crowd(spark, sf)))


@query
def item_edge_counts(spark, sf):
    e = H.item_edges(T.ship_events(spark, sf), T.ship_cases(spark, sf))
    return e.groupBy("dst_type", "item").agg(F.count(F.lit(1)).alias("n_edges"))


@query
def relation_edge_counts(spark, sf):
    cases, visits = T.ship_cases(spark, sf), T.ship_visits(spark, sf)
    items = H.item_edges(T.ship_events(spark, sf), cases)
    return H.edge_counts(items).unionByName(H.case_edge_count(visits))


@query
def node_map(spark, sf):
    return H.node_map(T.ship_events(spark, sf), T.ship_cases(spark, sf))


@query
def indexed_edges(spark, sf):
    events, cases = T.ship_events(spark, sf), T.ship_cases(spark, sf)
    nodes = cut(H.node_map(events, cases))
    e = H.indexed_edges(H.item_edges(events, cases), nodes)
    return e.groupBy("dst_type", "dst").agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum("src").alias("src_sum"), F.sum("weight").alias("weight")
    )


# -- network ------------------------------------------------------------------


@query
def degree_by_case(spark, sf):
    nodes = T.ship_cases(spark, sf).select(F.col("case_id").alias("node"))
    return C.with_nodes(nodes, neighbor_sums(L.members(T.ship_visits(spark, sf), 3)))


@query
def isolation_rate(spark, sf):
    labels = L.cluster_labels(T.ship_visits(spark, sf), [3])
    return tidy(N.isolation(T.ship_cases(spark, sf), labels, "label_3", "is_asymptomatic"))


@query
def isolation_overlap(spark, sf):
    labels = L.label_cases(T.ship_cases(spark, sf), L.cluster_labels(T.ship_visits(spark, sf), [0, 3]))
    return N.isolation_overlap(labels, "label_3", "label_0")


@query
def network_metrics_by_period(spark, sf):
    return tidy(N.slice_metrics(N.with_period(T.ship_visits(spark, sf), SHIP_CUTOVER), "period"))


@query
def network_change(spark, sf):
    periods = N.slice_metrics(N.with_period(T.ship_visits(spark, sf), SHIP_CUTOVER), "period")
    return tidy(N.pre_post_change(periods))


def _series(spark, sf):
    return cut(N.weekly_series(T.ship_visits(spark, sf), None, SHIP_CUTOVER, SHIP_FESTIVAL))


@query
def weekly_network_series(spark, sf):
    return tidy(N.weekly_series(T.ship_visits(spark, sf), None, SHIP_CUTOVER, SHIP_FESTIVAL))


@query
def active_week_summary(spark, sf):
    return tidy(N.active_week_summary(_series(spark, sf)))


@query
def connected_components(spark, sf):
    return member_components(L.shared(L.members(T.ship_visits(spark, sf), 0)))


def _nodes(spark, sf):
    return T.ship_cases(spark, sf).select(F.col("case_id").alias("node"))


@query
def local_rank(spark, sf):
    out = C.local_rank(L.members(T.ship_visits(spark, sf), 3), _nodes(spark, sf))
    n = F.lit(1.0) * _nodes(spark, sf).agg(F.count(F.lit(1))).scalar()
    return tidy(out.select("node", "degree", (F.col("local_rank") * n).alias("rank_times_n")))


@query
def global_rank(spark, sf):
    out = C.global_rank(L.members(T.ship_visits(spark, sf), 0), _nodes(spark, sf))
    n = F.lit(1.0) * _nodes(spark, sf).agg(F.count(F.lit(1))).scalar()
    return tidy(out.select("node", (F.col("global_rank") * n).alias("rank_times_n")))


@query
def two_hop_walks(spark, sf):
    return C.two_hop_walks(L.members(T.ship_visits(spark, sf), 3))


@query
def transitivity_share(spark, sf):
    return tidy(C.transitivity_share(L.members(T.ship_visits(spark, sf), 6)))


@query
def pair_weights(spark, sf):
    """Each edge of the ±3 day graph with its smallest gap and weight."""
    return tidy(L.pair_gaps(L.band_edges(T.ship_visits(spark, sf), 3)))


@query
def pair_weights_same_day(spark, sf):
    """Deduplicated edges of one day, of gap 0 and weight 1."""
    return tidy(L.pair_gaps(L.band_edges(T.ship_visits(spark, sf), 0)))


@query
def betweenness(spark, sf):
    out = C.betweenness(L.members(T.ship_visits(spark, sf), 0), _nodes(spark, sf).count())
    return tidy(out.select("node", (F.col("betweenness") * 1e6).alias("betweenness_ppm")))


@query
def top10_betweenness(spark, sf):
    m = L.members(T.ship_visits(spark, sf), 0)
    out = tidy(C.betweenness(m, _nodes(spark, sf).count()).withColumn("betweenness", F.col("betweenness") * 1e6))
    return out.orderBy(F.desc("betweenness"), "node").limit(10)


@query
def betweenness_band(spark, sf):
    """On the graph of three days, where cases share several groups."""
    out = C.betweenness(L.members(T.ship_visits(spark, sf), 3), _nodes(spark, sf).count())
    return tidy(out.select("node", (F.col("betweenness") * 1e6).alias("betweenness_ppm")))


# -- neighbour features -------------------------------------------------------


def _values(spark, sf):
    return T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation")
    )


@query
def neighbor_mean_feature(spark, sf):
    m = L.members(T.ship_visits(spark, sf), 3)
    return tidy(E.neighbor_means(m, _values(spark, sf), ["balance"]))


@query
def neighbor_max_feature(spark, sf):
    m = L.members(T.ship_visits(spark, sf), 3)
    return tidy(E.neighbor_maxima(m, _values(spark, sf), ["balance"]))


@query
def temporal_neighbor_mean(spark, sf):
    sums = decayed_sums(T.ship_visits(spark, sf), _values(spark, sf), ["balance"], 3, 7.0)
    return tidy(sums.select("node", "weight", (F.col("sum_balance") / F.col("weight")).alias("mean_balance")))


@query
def temporal_proximity(spark, sf):
    visits = T.ship_visits(spark, sf)
    days = visits.groupBy(F.col("case_id").alias("node")).agg(L.day_number(F.min("day")).alias("day"))
    return tidy(E.temporal_proximity(L.members(visits, 3), days))


@query
def gcn_propagation(spark, sf):
    m = L.members(T.ship_visits(spark, sf), 3)
    return tidy(E.gcn_propagate(m, _values(spark, sf), ["balance", "nation"]))


#: Fixed small weights of one attention pass: two inputs, two hidden values.
ATTENTION = {"project": [[0.31, -0.27], [0.18, 0.42]], "mix": [[0.9, -0.4], [0.3, 0.7]], "attend": [1.3, -0.8, 0.6, 1.1]}


def _hidden(spark, sf):
    """(node, g, s, t) of the fixed weights, on balance in thousands and nation in tens."""
    weights = {k: np.array(v) for k, v in ATTENTION.items()}
    return cut(E.project(_values(spark, sf), ["balance", "nation"], [0.0, 0.0], [1000.0, 10.0], weights))


@query
def graph_attention(spark, sf):
    return tidy(E.attention(L.members(T.ship_visits(spark, sf), 3), _hidden(spark, sf), 2))


@query
def crowd_attention(spark, sf):
    return tidy(E.attention(_crowd(spark, sf), _hidden(spark, sf), 2))


#: Fixed weights that one training step of each network starts from.
GCN_START = {"W": [[0.31, -0.27], [0.18, 0.42]], "u": [0.8, -0.6], "b": [0.05]}
GAT_START = {"W": [[0.31, -0.27], [0.18, 0.42]], "a1": [0.7, -0.4], "a2": [0.3, 0.9], "v": [0.8, -0.6], "b": [0.05]}


def _one_step(spark, sf, kind, start):
    """(name, i, j, gradient): the mean loss by each weight (in thousandths), and the loss itself.

    Inputs are balance in thousands and nation in tens; the label is a debt.
    """
    table = T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("node"),
        (F.col("c_acctbal") < 0).cast("int").alias("label"),
        F.when(F.col("c_custkey") % 10 < 7, "train").otherwise("test").alias("split"),
        (F.col("c_acctbal") / 1000).alias("balance"),
        (F.col("c_nationkey") / 10).alias("nation"),
    )
    net = GN.Network(kind, table, ["balance", "nation"], L.members(T.ship_visits(spark, sf), 3))
    loss, grad = net.step({k: np.array(v) for k, v in start.items()})
    rows = [("loss", 0, 0, float(loss))]
    for name, g in grad.items():
        flat = g.reshape(-1, 1) if g.ndim == 1 else g
        rows += [(name, i, j, 1000 * float(flat[i, j])) for i, j in np.ndindex(flat.shape)]
    return tidy(spark.createDataFrame(rows, "name string, i int, j int, gradient double"))


@query
def gcn_training_step(spark, sf):
    return _one_step(spark, sf, "gcn", GCN_START)


@query
def gat_training_step(spark, sf):
    return _one_step(spark, sf, "gat", GAT_START)


@query
def structure_features(spark, sf):
    m = L.members(T.ship_visits(spark, sf), 0)
    out = E.structure_features(m, _values(spark, sf), ["balance", "nation"])
    n = F.lit(1.0) * _nodes(spark, sf).agg(F.count(F.lit(1))).scalar()
    return tidy(out.withColumn("global_rank", F.col("global_rank") * n))


@query
def temporal_features(spark, sf):
    visits = T.ship_visits(spark, sf)
    days = visits.groupBy(F.col("case_id").alias("node")).agg(L.day_number(F.min("day")).alias("day"))
    m = cut(L.shared(L.members(visits, 3)))
    return tidy(E.temporal_features(m, _values(spark, sf), ["balance", "nation"], days))


# -- risk and inference -------------------------------------------------------


@query
def venue_risk_ranking(spark, sf):
    return tidy(risk.venue_risk_ranking(T.ship_visits(spark, sf)))


@query
def risk_rollup(spark, sf):
    """Exact counts and rates at each level, and whether the merged sketches are within five per cent."""
    rows = risk.risk_rollup(T.ship_visits(spark, sf))
    near = F.abs(F.col("cases_estimate") / F.col("n_cases") - 1) <= 0.05
    return tidy(rows.withColumn("estimate_near", near).drop("cases_estimate"))


@query
def venue_risk_with_importance(spark, sf):
    """Risk of the kinds of venue beside what a forest makes of their columns."""
    cases, events = _cases_events(spark, sf)
    data = _training(spark, sf).withColumn("label", F.col("label_0"))
    cols = _columns(data)
    model = ML.fit("RF", data.where("split = 'train'"), cols, numTrees=20, maxDepth=5)
    rows = risk.venue_risk_ranking(visits_of(events), ML.importances(model, cols, spark))
    return rows.select("venue", "n_cases", (F.col("feature_importance") > 0).alias("has_importance"))


@query
def venue_province_rates(spark, sf):
    return tidy(risk.venue_province_rates(T.ship_visits(spark, sf)))


@query
def venue_cluster_rate(spark, sf):
    return tidy(risk.venue_cluster_rate(T.ship_visits(spark, sf)))


@query
def anova_venue_risk(spark, sf):
    return tidy(risk.venue_anova(T.ship_visits(spark, sf)))


def _degrees(spark, sf):
    cases = T.ship_cases(spark, sf).select(F.col("case_id").alias("node"), "is_asymptomatic")
    deg = C.with_nodes(cases, neighbor_sums(L.members(T.ship_visits(spark, sf), 3)))
    return cut(deg.join(cases, "node"))


@query
def mann_whitney_degree(spark, sf):
    return tidy(I.mann_whitney(_degrees(spark, sf), "is_asymptomatic", "degree"))


@query
def cohens_d_degree(spark, sf):
    return tidy(I.cohens_d(_degrees(spark, sf), "is_asymptomatic", "degree"))


@query
def group_contrast(spark, sf):
    cases = T.ship_cases(spark, sf)
    pos = contrast.case_positions(cases, T.ship_visits(spark, sf), 3, paths=False)
    # Rounded, so that equal ranks tie whatever order their terms were added in.
    pos = pos.withColumn("local_rank", F.round(F.col("local_rank") * 1e6, 4))
    return tidy(contrast.group_contrast(pos, cases, "is_asymptomatic", ["degree", "local_rank", "transitivity"]))


@query
def its_normal_sums(spark, sf):
    s = I.active(_series(spark, sf)).withColumn("one", F.lit(1.0))
    return tidy(I.normal_sums(s, ["one", "t", "post", "post_weeks"], "n_edges"))


@query
def its_regression(spark, sf):
    return tidy(I.segmented_regression(_series(spark, sf), "n_edges"))


@query
def its_with_festival(spark, sf):
    return tidy(I.segmented_regression(_series(spark, sf), "n_edges", festival=True))


@query
def pre_post_slopes(spark, sf):
    series = _series(spark, sf)
    good = I.slopes(series, "n_edges").withColumnRenamed("slope", "slope")
    coded = I.slopes(series, "n_edges", as_coded=True).select("post", F.col("slope").alias("slope_as_coded"))
    return tidy(good.join(coded, "post"))


@query
def pre_trend(spark, sf):
    return tidy(I.pre_trend(_series(spark, sf), "n_edges"))


@query
def granger_lags(spark, sf):
    return tidy(I.lagged(_series(spark, sf), "avg_degree"))


@query
def granger_test(spark, sf):
    return tidy(I.granger(_series(spark, sf), "avg_degree"))


# -- features, split, scores --------------------------------------------------


def _cases_events(spark, sf):
    events = T.ship_events(spark, sf)
    return FT.with_dates(T.ship_cases(spark, sf), events), events


@query
def case_features(spark, sf):
    return tidy(FT.case_features(*_cases_events(spark, sf), cutover=SHIP_CUTOVER))


@query
def case_features_small(spark, sf):
    return tidy(FT.case_features(*_cases_events(spark, sf), cutover=SHIP_CUTOVER, symptoms=False))


@query
def row_stats_features(spark, sf):
    f = FT.row_stats(FT.case_features(*_cases_events(spark, sf), cutover=SHIP_CUTOVER))
    return tidy(f.select("case_id", *FT.ROW_STATS))


@query
def date_features(spark, sf):
    return tidy(FT.date_features(T.click_events(spark, sf).select(F.col("day").alias("date")), CLICK_CUTOVER))


@query
def hash_splits(spark, sf):
    return hash_split(T.ship_cases(spark, sf), "case_id")


def _scored(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    labels = T.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    score = 1 / (1 + F.exp((F.lit(1500) - F.col("n_chars")) / 1000.0))
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), "label", F.round(score, 3).alias("score"), F.round(1 - score, 2).alias("other")
    )


@query
def auc_ap_confusion(spark, sf):
    return tidy(M.classification_metrics(_scored(spark, sf)))


@query
def precision_at_20(spark, sf):
    return tidy(M.precision_at_k(_scored(spark, sf), 20))


def _seed_results(spark, sf):
    """Accuracy of two fixed scores on the test part of a split per seed, all seeds in one pass."""
    rows = cut(_scored(spark, sf))
    seeded = rows.select("*", F.explode(F.lit(list(sweeps.SEEDS))).alias("seed"))
    test = hash_splits_by_seed(seeded, "id").where("split = 'test'")
    hit = lambda s: F.avg(((F.col(s) >= 0.5).cast("int") == F.col("label")).cast("double"))
    model = lambda name, value: F.struct(F.lit(name).alias("model"), F.col(value).alias("value"))
    each = test.groupBy("seed").agg(hit("score").alias("a"), hit("other").alias("b"))
    return each.select("seed", F.explode(F.array(model("long", "a"), model("short", "b"))).alias("x")).select(
        "seed", "x.model", F.lit("Accuracy").alias("metric"), "x.value"
    )


@query
def seed_metric_summary(spark, sf):
    return tidy(M.seed_summary(_seed_results(spark, sf)))


@query
def paired_t_over_seeds(spark, sf):
    return tidy(I.paired_t(M.paired_by_seed(_seed_results(spark, sf), "long", "short", "Accuracy")))


@query
def wilcoxon_over_seeds(spark, sf):
    return tidy(I.wilcoxon_greater(M.paired_by_seed(_seed_results(spark, sf), "long", "short", "Accuracy")))


@query
def delta_to_baseline(spark, sf):
    rows = _scored(spark, sf)
    long = M.classification_metrics(rows).select(F.lit("long").alias("variant"), "*")
    short = M.classification_metrics(rows, "other").select(F.lit("short").alias("variant"), "*")
    return tidy(M.delta_to_baseline(long.unionByName(short), "long"))


# -- models (no SQL counterpart) ----------------------------------------------


def _training(spark, sf, ks=(0,), visits=None):
    cases, events = _cases_events(spark, sf)
    feats = FT.row_stats(FT.case_features(cases, events, cutover=SHIP_CUTOVER))
    return sweeps.training_table(feats, L.cluster_labels(T.ship_visits(spark, sf) if visits is None else visits, ks))


def _columns(df):
    return [c for c in df.columns if c not in ("case_id", "split") and not c.startswith("label")]


SETTINGS = {
    "LR": {},
    "RF": {"numTrees": 100, "maxDepth": 10},
    "GBM": {"maxIter": 100, "maxDepth": 5},
    "MLP": {"hidden": [128, 64], "maxIter": 60},
    "SVM": {"dims": 256},
}


@query
def model_scores(spark, sf):
    data = _training(spark, sf).withColumn("label", F.col("label_0"))
    cols = _columns(data)
    out = None
    for name, kw in SETTINGS.items():
        one = ML.evaluate(name, data, cols, **kw).select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return tidy(out)


@query
def training_counts(spark, sf):
    """Rows and positives of each part that the learners see."""
    data = _training(spark, sf, sweeps.WINDOWS)
    return data.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"label_{k}").cast("long").alias(f"positive_{k}") for k in sweeps.WINDOWS]
    )


@query
def feature_importance(spark, sf):
    data = _training(spark, sf).withColumn("label", F.col("label_0"))
    cols = _columns(data)
    model = ML.fit("RF", data.where("split = 'train'"), cols, **SETTINGS["RF"])
    return tidy(ML.importances(model, cols, spark))


@query
def window_sweep_scores(spark, sf):
    data = _training(spark, sf, sweeps.WINDOWS)
    return tidy(sweeps.window_sweep(data, _columns(data), sweeps.WINDOWS, "LR"))


@query
def group_ablation_scores(spark, sf):
    data = _training(spark, sf)
    return tidy(sweeps.group_ablation(data, _columns(data), sweeps.GROUPS, 0, "LR"))


def _model_seeds(spark, sf):
    """(seed, model, metric, value) of two learners over five splits."""
    cases, events = _cases_events(spark, sf)
    feats = cut(FT.row_stats(FT.case_features(cases, events, cutover=SHIP_CUTOVER)))
    labels = cut(L.cluster_labels(T.ship_visits(spark, sf), (0,)))
    cols = [c for c in feats.columns if c != "case_id"]
    return cut(sweeps.seed_sweep(feats, labels, cols, ["LR", "RF"], 0, settings=SETTINGS))


@query
def model_seed_scores(spark, sf):
    return tidy(M.seed_summary(_model_seeds(spark, sf)))


@query
def model_paired_scores(spark, sf):
    return tidy(I.paired_t(M.paired_by_seed(_model_seeds(spark, sf), "RF", "LR", "AUC-ROC")))


@query
def graph_embedding(spark, sf):
    cases, events = _cases_events(spark, sf)
    feats = cut(FT.case_features(cases, events, cutover=SHIP_CUTOVER).withColumnRenamed("case_id", "node"))
    cols = [c for c in feats.columns if c != "node"]
    visits = T.ship_visits(spark, sf)
    weights = E.random_weights(len(cols))
    return tidy(E.embed(feats, cols, L.members(visits, 0), visits, E.fit_scale(feats, cols), weights))


def _graph_training(spark, sf, every=False):
    """Training rows, six of their columns (or all), and the shared groups of the ±3 day graph.

    The graph is that of the first period and the label that of the second, so no
    feature shows the label.
    """
    visits = T.ship_visits(spark, sf)
    later = visits.where(F.col("day") >= SHIP_CUTOVER)
    table = _training(spark, sf, visits=later).withColumn("label", F.col("label_0")).drop("label_0")
    cols = ["age_norm", "is_male", "first_day_norm", "duration_norm", "event_count_norm", "venue_total"]
    return table, _columns(table) if every else cols, cut(L.shared(L.members(visits.where(F.col("day") < SHIP_CUTOVER), 3)))


@query
def graph_embedding_scores(spark, sf):
    table, cols, m = _graph_training(spark, sf)
    visits = T.ship_visits(spark, sf).where(F.col("day") < SHIP_CUTOVER)
    return tidy(GM.embedding_scores(table, cols, m, visits, maxIter=60))


@query
def graph_convolution_scores(spark, sf):
    table, cols, m = _graph_training(spark, sf)
    return tidy(GM.convolution_scores(table, cols, m))


@query
def graph_attention_scores(spark, sf):
    table, cols, m = _graph_training(spark, sf)
    return tidy(GM.attention_scores(table, cols, m))


@query
def gcn_trained_scores(spark, sf):
    table, cols, m = _graph_training(spark, sf, every=True)
    return tidy(GM.network_scores("gcn", table, cols, m, epochs=10))


@query
def gat_trained_scores(spark, sf):
    table, cols, m = _graph_training(spark, sf, every=True)
    return tidy(GM.network_scores("gat", table, cols, m, epochs=10))


@query
def graph_structure_scores(spark, sf):
    table, cols, m = _graph_training(spark, sf)
    return tidy(GM.structure_scores(table, cols, m, maxIter=60))


@query
def graph_temporal_scores(spark, sf):
    table, cols, m = _graph_training(spark, sf)
    visits = T.ship_visits(spark, sf)
    days = visits.groupBy(F.col("case_id").alias("node")).agg(L.day_number(F.min("day")).alias("day"))
    return tidy(GM.temporal_scores(table, cols, m, days, maxIter=100))
