"""Shared decoding, exchangeable rules, exact matching, ranged percentiles, studies and latencies."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from syndromeframe import facade, study
from syndromeframe.functions import bits, stats
from syndromeframe.operators import color, decode, dual, kernel, lattice, matching, verify
from syndromeframe.plans import store
from syndromeframe.plans.grids import BOUNDARIES, Grid
from syndromeframe.sources import dem, noise, sinks
from syndromeframe.streaming import window

RULES = [kernel.Rules(g, s) for g in ("half", "whole") for s in ("boundary", "root")]


@pytest.mark.parametrize("preset", sorted(BOUNDARIES))
@pytest.mark.parametrize("topology", ["square", "triangular", "honeycomb"])
def test_thin_lattices(preset, topology):
    rng = np.random.default_rng(3)
    for w, h in ((1, 1), (1, 2), (2, 1), (1, 7), (7, 1)):
        adj = lattice.Adjacency(Grid(w, h, 1, topology, BOUNDARIES[preset]))
        on = rng.random((40, w * h)) < 0.4
        for rules in RULES:
            shot, node = np.nonzero(on)
            cs, ce, ls, ln = kernel.decode(adj, shot, node, 40, rules=rules)
            left = on.astype(int)
            np.add.at(left, (cs, adj.u[ce]), 1)
            inner = adj.v[ce] >= 0
            np.add.at(left, (cs[inner], adj.v[ce][inner]), 1)
            still = np.zeros_like(left)
            still[ls, ln] = 1
            assert (left % 2 == still).all()
            if preset == "all":
                assert not len(ls)


def test_unknown_rules():
    with pytest.raises(ValueError):
        kernel.Rules("double")


def toggles(spark, grid, shots, p, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(s), grid.node(int(x), int(y), int(t))) for s in range(shots) for t in range(grid.depth) for y in range(grid.height) for x in range(grid.width) if rng.random() < p]
    return spark.createDataFrame(rows + [(s, 0) for s in range(shots)] * 2, "shot_id bigint, node bigint")


def test_carried_rows_verify_like_the_join(spark):
    g = Grid(6, 5, 3, "grid3d", BOUNDARIES["horizontal_only"])
    t = toggles(spark, g, 60, 0.1)
    found = decode.decode(t, g, carry=True)
    own = {r.shot_id: (r.n_defects, r.remaining, r.resolved) for r in verify.carried(found).collect()}
    joined = {r.shot_id: (r.n_defects, r.remaining, r.resolved) for r in verify.resolved(t, decode.corrections(found), g).collect()}
    assert own == joined and len(own) == 60


def test_packed_rows_decode_like_nodes(spark):
    g = Grid(6, 5, 3, "grid3d")
    t = toggles(spark, g, 50, 0.1)
    odd = t.groupBy("shot_id", "node").count().filter("count % 2 = 1").select("shot_id", "node")
    one = {r.shot_id: (r.n_defects, r.u, r.v) for r in decode.decode(odd, g).collect()}
    assert {r.shot_id: (r.n_defects, r.u, r.v) for r in decode.decode_packed(bits.pack(odd), g).collect()} == one


def test_dense_shots_are_not_decoded(spark):
    g = Grid(9, 9)
    t = toggles(spark, g, 40, 0.08)
    whole = {r.shot_id: (r.n_defects, r.u) for r in decode.decode(t, g).collect()}
    few = {r.shot_id: (r.n_defects, r.u) for r in decode.decode_sparse(t, g, 5).collect()}
    assert few == {s: x for s, x in whole.items() if x[0] <= 5} and 0 < len(few) < 40


def test_bases_and_colours_decode_as_if_alone(spark):
    g = Grid(7, 6, 2, "grid3d")
    t = toggles(spark, g, 30, 0.12)
    rows = {(r.shot_id, r.basis): (r.n_defects, r.u, r.v) for r in dual.decode(t, g).collect()}
    for basis in dual.BASES:
        small = dual.compact(g, basis)
        own = dual.split(t, g).filter(F.col("basis") == basis).select("shot_id", (F.col("t") * small.stride_z + F.col("cy") * small.stride_y + F.col("cx")).alias("node"))
        alone = {(r.shot_id, basis): (r.n_defects, r.u, r.v) for r in decode.decode(own, small, dual._phantoms(g, basis)).collect()}
        assert alone == {k: v for k, v in rows.items() if k[1] == basis}
    faces = Grid(9, 9)
    t = toggles(spark, faces, 30, 0.1)
    v = verify.carried(color.decode(t, faces)).collect()
    assert v and all(r.n_unresolved == 0 for r in v) and {r.color for r in v} == {0, 1, 2}


def test_a_hot_shot_is_folded(spark, monkeypatch):
    g = Grid(4, 4)
    adj = lattice.Adjacency(g)
    rng = np.random.default_rng(5)
    node = rng.integers(-2, 20, 5000)
    keep, lost = decode._fold(adj, node, None)
    inside = adj.to_dense(node) >= 0
    assert lost + (adj.to_dense(node[keep]) < 0).sum() == (~inside).sum() and len(keep) <= 2 * 16 + 22
    for n in range(16):
        assert (node[keep] == n).sum() % 2 == (node == n).sum() % 2
    import pyarrow as pa
    from functools import partial

    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(100, 7)), pa.array(node[i : i + 100])], ["shot_id", "node"]) for i in range(0, 5000, 100)]
    make = partial(decode._run, partial(lattice.Adjacency, g, frozenset()), False, True, None, kernel.RULES)
    whole = [b.drop_columns(["decode_us"]).to_pydict() for b in make()(batches)]
    monkeypatch.setattr(decode, "FOLD_ROWS", 50)
    assert [b.drop_columns(["decode_us"]).to_pydict() for b in make()(batches)] == whole


def brute_weight(grid, nodes):
    """Least weight over all pairings by recursion."""
    if not nodes:
        return 0
    (a, *rest), b = nodes, grid.boundary
    x, y, t = grid.coord(a)
    out = [1 << 20] + [d + 1 for on, d in ((b.left, x), (b.right, grid.width - 1 - x), (b.top, y), (b.bottom, grid.height - 1 - y)) if on]
    best = min(out) + brute_weight(grid, rest)
    for k, c in enumerate(rest):
        cx, cy, ct = grid.coord(c)
        best = min(best, abs(x - cx) + abs(y - cy) + abs(t - ct) + brute_weight(grid, rest[:k] + rest[k + 1 :]))
    return best


def test_matching_is_exact_and_never_above_clusters(spark):
    rng = np.random.default_rng(9)
    for preset in ("all", "none", "vertical_only"):
        g = Grid(8, 8, 3, "grid3d", BOUNDARIES[preset])
        for n in (0, 1, 2, 5, 6):
            nodes = sorted({g.node(int(x), int(y), int(t)) for x, y, t in zip(rng.integers(0, 8, n), rng.integers(0, 8, n), rng.integers(0, 3, n), strict=True)})
            assert matching.match(g, np.array(nodes, np.int64))[0] == brute_weight(g, nodes)
    p = study.compare_study(spark, [5], [0.03], 500).first()
    assert p.heavier == 0 and p.shots > 300 and p.matching_errors <= p.clusters_errors + 10
    with pytest.raises(ValueError):
        matching.decode(spark.createDataFrame([], "shot_id bigint, node bigint"), Grid(3, 3, 1, "triangular"))


def test_percentiles_against_sorted_lists(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.choice([1.0, 2.0, 2.5], 3000)] + [("wide", float(x)) for x in rng.lognormal(0, 3, 700)] + [("one", 4.0), ("null", None)]
    got = {r.k: r for r in stats.percentiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", ranks=("round", "trunc", "integer")).collect()}
    assert set(got) == {"hot", "wide", "one"}
    for k, r in got.items():
        v = sorted(x for name, x in rows if name == k)
        n = len(v)
        assert (r.n, r.low, r.high) == (n, v[0], v[-1]) and abs(r["mean"] - np.mean(v)) < 1e-6 * max(v)
        for q, (rank, at) in itertools.product((50, 95, 99), (("round", lambda q: int(q / 100 * (n - 1) + 0.5)), ("trunc", lambda q: int(n * (q / 100))), ("integer", lambda q: n * q // 100))):
            assert r[f"{rank}_p{q}"] == v[min(at(q), n - 1)]


def test_numbered_edges_are_in_order(spark):
    for topology in ("square", "triangular", "honeycomb"):
        rows = lattice.edges(spark, Grid(7, 6, 1, topology)).collect()
        assert sorted(r.edge_id for r in rows) == list(range(len(rows)))
        inner = sorted((r.edge_id, r.u, r.v) for r in rows if r.v is not None)
        assert [x[1:] for x in inner] == sorted(x[1:] for x in inner) and inner[-1][0] == len(inner) - 1


def test_strides():
    assert facade.DecoderBuilder().dimensions(5, 5).stride_y(32).build().grid.stride_y == 32
    for bad in (4, 24):
        with pytest.raises(ValueError):
            facade.DecoderBuilder().dimensions(5, 5).stride_y(bad).build()
    d = facade.DecoderBuilder().dimensions(5, 5).stride_y(64).build()
    words = np.zeros(10, np.uint64)
    words[2] = np.uint64(0b110)  # nodes 129 and 130: x 1 and 2 of row 2
    assert d.decode(words).tolist() == [129, 130]


def test_rates_that_differ_by_rounding_are_one():
    assert study.distinct_rates([0.1 + 0.2, 0.3, 0.1, 0.3 + 1e-6]) == [0.1, 0.3, 0.3 + 1e-6]


def test_unexpected_ends(spark):
    text = "error(0.1) D0\nerror(0.2\nrepeat 3 {\nerror(0.1) D1\n"
    kinds = {(r.line, r.kind) for r in dem.errors(dem.of_text(spark, text)).collect()}
    assert kinds == {(1, "unexpected_end"), (3, "unexpected_end")}


def test_latencies_and_csv_hold_measured_values(spark):
    p = study.stream_study(spark, 3, [0.02, 0.05], 20, 2, timed=True)
    rows = p.collect()
    assert len(rows) == 2 and all(r.flush_us > 0 and r.decode_us > 0 and r.remaining == 0 and r.memory > 0 for r in rows)
    assert all(line.line.count(",") == sinks.STREAMING_HEADER.count(",") for line in sinks.streaming_lines(p).collect())
    t = study.threshold_study(spark, [3], [0.02], 100).first()
    assert t.decode_us > 0 and t.verified == 100
    c = study.color_study(spark, [3], [0.02], 100)
    assert all(line.line.count(",") == sinks.COLOR_HEADER.count(",") for line in sinks.color_lines(c).collect()) and c.first().errors <= 100


def test_latencies_commit_what_the_replay_does(spark):
    rng = np.random.default_rng(2)
    rows = [(s, r, int(rng.integers(4)), int(rng.integers(4)), bool(rng.random() < 0.5)) for s in range(5) for r in range(9)]
    df = spark.createDataFrame(rows, "stream_id bigint, round bigint, x bigint, y bigint, on boolean")
    n = {r.stream_id: r.n for r in window.replay(df, 4, 4, 3).groupBy("stream_id").agg(F.count("*").alias("n")).collect()}
    got = {r.stream_id: r for r in window.latencies(df, 4, 4, 3).collect()}
    assert len(got) == 5 and all(r.rounds == 9 and r.commits == n.get(s, 0) for s, r in got.items())


def test_command_line(spark, tmp_path, capsys):
    chain = "error(0.1) D0 L0\nerror(0.1) D0 D1\nerror(0.1) D1\n"
    (tmp_path / "x_d3_r1_p0.1.dem").write_text(chain)
    study.main(["--dem-dir", str(tmp_path), "--shots", "500", "--csv"])
    out = capsys.readouterr().out
    assert sinks.THRESHOLD_HEADER in out and "\n3,0.100000,1,500," in out
    study.main(["--color", "--distances", "3", "--error-probs", "0.02", "--shots", "50", "--csv"])
    assert "\n3,0.020000,50,3," in capsys.readouterr().out
    study.main(["--dual-decode", "--distances", "3", "--error-probs", "0.02", "--shots", "50", "--csv"])
    assert sinks.DUAL_HEADER in capsys.readouterr().out


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        store.new_path(Session(), "x")


def test_erased_parts_and_noise(spark):
    n = noise.uniform(spark, Grid(5, 5), 0.05, 200)
    found = decode.decode(n, Grid(5, 5), erased=[6, 7], carry=True).collect()
    assert all(6 not in r.u + r.v and 7 not in r.u + r.v for r in found)
