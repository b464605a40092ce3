"""Hand-computed small graphs and the three known panel rows."""

import datetime as dt

import pytest

from kinweave.operators import edges, features, panel
from kinweave.schemas import PANEL_COLUMNS, Logs

EDGE = "project string, month int, src string, dst string, weight long"


def graph(spark, links, nodes, project="p", month=0):
    both = [(project, month, a, b, 1) for a, b in links] + [(project, month, b, a, 1) for a, b in links]
    return spark.createDataFrame(both + [(project, month, n, n, 0) for n in nodes], EDGE)


@pytest.mark.parametrize("links,nodes,clustering,components,largest", [
    ([("a", "b"), ("b", "c"), ("a", "c")], "abc", 1.0, 1, 3),
    ([("a", "b"), ("a", "c"), ("a", "d")], "abcd", 0.0, 1, 4),
    ([("a", "b"), ("c", "d")], "abcd", 0.0, 2, 2),
    ([], "a", 0.0, 1, 1),
    ([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "abcde", (1 + 1 + 1 / 3) / 5, 2, 4),
])
@pytest.mark.parametrize("path", ["one task", "rounds"])
def test_shape(spark, links, nodes, clustering, components, largest, path):
    g = graph(spark, links, nodes)
    hot = 0 if path == "rounds" else 10**6
    assert features.clustering(g, hot_rows=hot).first()["s_avg_clustering_coef"] == pytest.approx(clustering)
    found = features.components(g, small=0 if path == "rounds" else 10**6).first()
    assert (found["s_num_component"], found["s_largest_component"]) == (components, largest)


def test_social_numbers(spark):
    row = features.social_features(graph(spark, [("a", "b")], "abc")).first()
    assert row["s_num_nodes"] == 3
    assert row["s_weighted_mean_degree"] == pytest.approx(4 / 3)
    assert row["s_graph_density"] == pytest.approx(5 / 6)
    alone = features.social_features(graph(spark, [], "a")).first()
    assert alone["s_graph_density"] == 0.0


MESSAGE = "project string, month int, message_id string, dev string, ts timestamp_ntz, in_reply_to string, is_bot int"


def messages(spark, *given):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [("p", m, i, d, start + dt.timedelta(days=31 * m, minutes=n), r, b)
         for n, (m, i, d, r, b) in enumerate(given)], MESSAGE)


def test_replies(spark, rows):
    log = messages(
        spark,
        (0, "<1>", "ann", None, 0), (0, "<2>", "ann", "<1>", 0),          # a self reply
        (0, "<3>", "bob", "<1> <2>", 0),                                  # two replies to one author
        (1, "<4>", "bob", "<3>", 0),                                      # a reply to last month
        (0, "<5>", "auto", "<1>", 1), (0, "<6>", "cat", "<5>", 0),        # a bot, and a reply to it
    )
    assert rows(edges.social_graph(log), "month", "src", "dst", "weight") == sorted([
        (0, "ann", "ann", 0), (0, "bob", "bob", 0), (0, "cat", "cat", 0), (1, "bob", "bob", 0),
        (0, "ann", "bob", 1), (0, "bob", "ann", 1)], key=repr)
    parts = edges.social_edges(edges.reply_pairs(log)).unionByName(edges.presence_loops(log))
    assert rows(parts, "month", "src", "dst", "weight") == rows(
        edges.social_graph(log), "month", "src", "dst", "weight")
    across = edges.social_graph(log, cross_month=True).where("src <> dst AND month = 1")
    assert rows(across, "src", "dst", "weight") == []                     # bob answered himself


def test_copies_count(spark, rows):
    log = messages(spark, (0, "<1>", "ann", None, 0), (0, "<2>", "bob", "<1>", 0))
    twice = log.unionByName(log.where("dev = 'bob'"))
    assert rows(edges.social_graph(twice).where("src <> dst"), "src", "dst", "weight") == [
        ("ann", "bob", 2), ("bob", "ann", 2)]
    assert edges.reply_pairs(twice).first()["n"] == 2
    assert edges.interaction_map(edges.reply_pairs(twice)).count() == 4


def test_broken_reference(spark):
    log = messages(spark, (0, "<12>", "ann", None, 0), (0, "<3>", "bob", "<1\n2>", 0))
    assert edges.reply_pairs(log).first()["prev_dev"] == "ann"


def test_vis_pages(spark, rows):
    tech = spark.createDataFrame(
        [("p", 0, f"f{i}.t{i}", "ann", 1) for i in range(7)], "project string, month int, file string, dev string, weight long")
    social = graph(spark, [("a", "b")], "ab")
    pages = edges.vis_package(tech, social, page_rows=3)
    assert rows(pages.where("graph = 'tech'"), "page", "rows") == [(0, 3), (1, 3), (2, 1)]
    with pytest.raises(ValueError):
        edges.vis_package(tech, social, project="other")


def known_edges(spark):
    """17, 20 and 7 one-to-one edges, 7 and 2 of them shared with the month before."""
    months = [range(0, 17), range(10, 30), [10, 11, *range(40, 45)]]
    data = [("m", m, f"f{i}", f"d{i}", 1) for m, ids in enumerate(months) for i in ids]
    return spark.createDataFrame(data, "project string, month int, file string, dev string, weight long")


def test_known_panel(spark):
    lengths = spark.createDataFrame([("m", 4), ("z", 0)], "project string, months int")
    empty = spark.createDataFrame([], EDGE)
    out = panel.build_panel(known_edges(spark), empty, lengths)
    assert out.columns == PANEL_COLUMNS
    got = [
        (r["month"], r["t_num_dev_nodes"], r["t_num_file_nodes"], r["t_num_dev_per_file"],
         round(r["t_graph_density"], 6), round(r["t_net_overlap"], 6), r["s_num_nodes"])
        for r in out.orderBy("month").collect()]
    assert got == [
        (0, 17, 17, 1.0, 0.058824, 0.0, 0), (1, 20, 20, 1.0, 0.05, 0.189189, 0),
        (2, 7, 7, 1.0, 0.142857, 0.074074, 0), (3, 0, 0, 0.0, 0.0, 0.0, 0)]


def test_property_note(spark):
    data = [("p", 0, "a.py", "x", 1), ("p", 0, "a.py   (with props)", "x", 1)]
    tech = spark.createDataFrame(data, "project string, month int, file string, dev string, weight long")
    row = features.tech_features(tech).first()
    assert (row["t_num_file_nodes"], row["t_graph_density"]) == (1, 1.0)


def test_months_before_the_first_commit(spark):
    day = lambda m: dt.datetime(2024, m, 5)
    tech = spark.createDataFrame(
        [("p", day(3), "ann", "a.py"), ("p", day(4), "ann", "a.py")],
        "project string, ts timestamp_ntz, sender string, file string")
    social = spark.createDataFrame(
        [("p", day(2), "ann", "s", "<1>"), ("p", day(3), "ann", "s", "<2>"), ("p", day(5), "bob", "s", "<3>")],
        "project string, ts timestamp_ntz, sender string, subject string, message_id string")
    out = {r["month"]: r for r in panel.panel_from_logs(Logs(tech, social)).collect()}
    assert sorted(out) == [0, 1, 2]
    assert out[0]["s_net_overlap"] == 0.0 and out[0]["st_num_dev"] == 1
    assert out[1]["t_net_overlap"] == 0.5 and out[2]["s_num_nodes"] == 1
