"""The syndrome engine: annihilation on random lattices, equal results of its forms, streams and sources."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from syndromeframe import facade, study
from syndromeframe.functions import bits, ids
from syndromeframe.operators import decode, kernel, lattice, tiled, verify
from syndromeframe.plans import grids
from syndromeframe.plans.grids import BOUNDARIES, Grid
from syndromeframe.sources import dem, noise, sinks, tables
from syndromeframe.streaming import window


def clear(adj, shots, shot, node):
    """Defects left after the kernel's correction, and the unresolved it reports."""
    cs, ce, ls, _ = kernel.decode(adj, shot, node, shots)
    left = np.zeros((shots, len(adj.public)), int)
    np.add.at(left, (shot, node), 1)
    np.add.at(left, (cs, adj.u[ce]), 1)
    inner = adj.v[ce] >= 0
    np.add.at(left, (cs[inner], adj.v[ce][inner]), 1)
    return left % 2, ls


grid_shapes = st.tuples(st.integers(1, 20), st.integers(1, 20), st.sampled_from(["square", "triangular", "honeycomb"]), st.sampled_from(sorted(BOUNDARIES)))


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(grid_shapes, st.integers(0, 40), st.integers(0, 1000))
def test_annihilation_2d(shape, n, seed):
    w, h, topology, preset = shape
    adj = lattice.Adjacency(Grid(w, h, 1, topology, BOUNDARIES[preset]))
    rng = np.random.default_rng(seed)
    cells = np.unique(rng.integers(0, 3 * w * h, n))
    left, unresolved = clear(adj, 3, cells // (w * h), cells % (w * h))
    assert left.sum() == len(unresolved)
    if preset == "all" or topology == "square" and preset != "none":
        assert not left.any()


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(2, 6), st.floats(0, 0.3), st.integers(0, 99))
def test_annihilation_3d(w, h, d, p, seed):
    adj = lattice.Adjacency(Grid(w, h, d, "grid3d"))
    on = np.random.default_rng(seed).random((2, w * h * d)) < p
    left, unresolved = clear(adj, 2, *np.nonzero(on))
    assert not left.any() and not len(unresolved)


@pytest.mark.parametrize("pairs", [[(2, 2), (3, 2)], [(2, 2), (2, 4)], [(0, 0), (1, 0)], [(9, 9), (8, 9)], [(2, 2), (4, 2), (6, 2), (8, 2)], [(5, 5)]])
def test_named_scenarios(pairs):
    g = Grid(10, 10)
    words = np.zeros(g.words, np.uint64)
    for x, y in pairs:
        words[g.node(x, y) // 64] ^= np.uint64(1) << np.uint64(g.node(x, y) % 64)
    flat = facade.Decoder(10, 10).decode(words)
    assert flat.dtype == np.uint32 and len(flat) % 2 == 0
    for u, v in flat.reshape(-1, 2).tolist():
        for n in (u, v):
            if n != facade.BOUNDARY:
                words[n // 64] ^= np.uint64(1) << np.uint64(n % 64)
    assert not words.any()


def test_facade_errors_and_erasure():
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            facade.Decoder(*bad)
    with pytest.raises(ValueError):
        facade.Decoder(3, 3, "pentagon")
    with pytest.raises(ValueError):
        facade.required_buffer_size(0, 3)
    with pytest.raises(ValueError):
        facade.DecoderBuilder().build()
    assert facade.Decoder(4, 4, "GRID3D", 2).grid == facade.DecoderBuilder("3d").dimensions_3d(4, 4, 2).build().grid
    assert facade.TopologyType("Square") == facade.TopologyType.Square != facade.TopologyType.Grid3D
    e = facade.QecEngine(4, 4)
    e.load_erasures(np.array([0b10], np.uint64))
    got = e.process_cycle_dense(np.array([0b101], np.uint64))
    assert got and all(1 not in pair for pair in got)
    g = Grid(5, 3)
    dense = np.random.default_rng(0).random(15) < 0.5
    assert (facade.dense_booleans(facade.pack_booleans(dense, g), g) == dense).all()


def test_neighbours_are_what_edges_say(spark):
    for topology in ("square", "triangular", "honeycomb"):
        g = Grid(6, 5, 1, topology)
        adj = lattice.Adjacency(g)
        got = [(r.u, r.v) for r in lattice.edges(spark, g).orderBy("edge_id").collect()]
        assert got == [(int(adj.public[u]), int(adj.public[v]) if v >= 0 else None) for u, v in zip(adj.u, adj.v, strict=True)]


def test_tiled_equals_kernel(spark):
    g = Grid(9, 7)
    rng = np.random.default_rng(8)
    rows = sorted({(int(s), g.node(int(x), int(y))) for s, x, y in zip(rng.integers(0, 2, 12), rng.integers(0, 9, 12), rng.integers(0, 7, 12), strict=True)})
    d = spark.createDataFrame(rows, "shot_id bigint, node bigint")
    key = lambda r: (r.shot_id, r.u, r.v is None, r.v or 0)
    one = sorted(decode.corrections(decode.decode(d, g)).collect(), key=key)
    two = sorted(tiled.corrections(d, spark, g).collect(), key=key)
    assert [tuple(r) for r in one] == [tuple(r) for r in two]


def test_decode_drops_and_reports(spark):
    d = spark.createDataFrame([(1, 0), (1, 999), (2, 3), (2, 3), (None, 1), (3, None), (4, -5)], "shot_id bigint, node bigint")
    got = {r.shot_id: (r.n_defects, r.n_outside, r.n_unresolved) for r in decode.decode(d, Grid(4, 4)).collect()}
    assert got == {1: (1, 1, 0), 2: (0, 0, 0), 4: (0, 1, 0)}
    none = {r.shot_id: r.n_unresolved for r in decode.decode(d, Grid(4, 4).with_boundary("none")).collect()}
    assert none[1] == 1
    assert decode.decode(d.limit(0), Grid(4, 4)).count() == 0


def test_pack_keeps_the_sign_bit(spark):
    d = spark.createDataFrame([(1, 63), (1, 0), (1, 127)], "shot_id bigint, node bigint")
    packed = bits.pack(d)
    assert {(r.word_idx, r.word) for r in packed.collect()} == {(0, -(1 << 63) + 1), (1, -(1 << 63))}
    assert sorted(r.node for r in bits.unpack(packed).collect()) == [0, 63, 127]
    assert bits.popcounts(packed).first().n_defects == 3


def test_observable_rules(spark):
    g = Grid(5, 5)
    n = lattice.nodes(spark, g).select("x", "y", ids.side_observable(g, "x", "y").alias("side"), ids.boundary_observable(g, "x", "y").alias("near"))
    at = {(r.x, r.y): (r.side, r.near) for r in n.collect()}
    assert at[(2, 2)] == (0, 2) and at[(0, 2)] == (2, 2) and at[(2, 0)] == (1, 1) and at[(4, 4)] == (3, 2)


def test_dem_repeat_and_compat(spark, tmp_path):
    text = "error(0.1) D0 D1\nrepeat 2 {\n error(0.2) D0 ^ D1 L0\n shift_detectors(0,0,1) 2\n}\ndetector(1.5, 2.5, 0) D0\nerror(0.3) D0 L1"
    (tmp_path / "a_d3_r3_p0.1.dem").write_text(text)
    (tmp_path / "skip.txt").write_text("x")
    rows = dem.lines(spark, str(tmp_path))
    m = [(r.p, r.detectors, r.frame) for r in dem.mechanisms(rows).orderBy("mech_id").collect()]
    assert m == [(0.1, [0, 1], 0), (0.2, [0, 1], 1), (0.2, [2, 3], 1), (0.3, [4], 2)]
    old = [(r.p, r.detectors, r.frame) for r in dem.mechanisms(dem.of_text(spark, text), compat=True).orderBy("mech_id").collect()]
    assert old[1] == (0.2, [0], 1) and old[3] == (0.3, [4], 0)
    det = dem.detectors(rows).first()
    assert (det.det_id, det.x, det.y, det.t) == (4, 1.5, 2.5, 2.0)
    assert study.model_study(spark, str(tmp_path), 10).first().distance == 3


def test_decoder_beats_no_decoder(spark):
    p = {r.distance: r for r in study.threshold_study(spark, [5], [0.001], 4000).collect()}[5]
    assert p.verified == p.shots and p.errors < p.no_decoder_errors


def test_window_commits_in_order_and_clears():
    rng = np.random.default_rng(6)
    for size in (1, 2, 3, 20):
        d = window.WindowDecoder(4, 4, size)
        left, out = {}, []
        for r in range(15):
            cells = [(int(x), int(y)) for x, y in rng.integers(0, 4, (rng.integers(0, 4), 2))]
            for x, y in cells:
                left[d.node(x, y, r)] = left.get(d.node(x, y, r), 0) + 1
            out += list(d.push(r, cells))
            assert d.state["head"] - d.state["tail"] <= size
        out += list(d.flush())
        assert [r[0] for r in out] == sorted(r[0] for r in out)
        for _, u, v, _ in out:
            for n in (u, v):
                if n is not None:
                    left[n] = left.get(n, 0) + 1
        assert not any(n % 2 for n in left.values())
        assert not list(d.push(0, [(1, 1)])) and d.state["late"] == 1


def test_lockstep_and_long_streams_equal_one_decoder(spark, monkeypatch):
    rng = np.random.default_rng(17)
    rows = [(s, r, int(rng.integers(5)), int(rng.integers(4)), bool(rng.random() < 0.7)) for s in range(6) for r in sorted(rng.integers(0, 4 + 6 * s, 3 + 8 * s).tolist())]
    cols = [np.array([r[k] for r in rows]) for k in range(5)]
    for size in (1, 2, 3, 9):
        want = []
        for s in range(6):
            d, own = window.WindowDecoder(5, 4, size), [r for r in rows if r[0] == s]
            for t in sorted({r[1] for r in own}):
                want += [(s, *e) for e in d.push(t, [(r[2], r[3]) for r in own if r[1] == t and r[4]])]
            want += [(s, *e) for e in d.flush()]
        key = lambda r: tuple(-1 if x is None else x for x in r)
        got = [tuple(r.values()) for b in window._lockstep(cols, 5, 4, size) for r in b.to_pylist()]
        assert sorted(got, key=key) == sorted(want, key=key)
        long = []
        for s in range(6):
            own = [c[cols[0] == s] for c in cols[1:]]
            half = int(np.searchsorted(own[0], own[0][len(own[0]) // 2]))
            stream = window._LongStream(s, 5, 4, size)
            for part, end in (([c[:half] for c in own], False), ([c[half:] for c in own], True)):
                long += [tuple(r.values()) for b in stream.feed(*part, end) for r in b.to_pylist()]
        assert sorted(long, key=key) == sorted(want, key=key)


def test_stream_equals_replay(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = [(s, r, int(rng.integers(4)), int(rng.integers(4)), bool(rng.random() < 0.6), False) for s in range(3) for r in range(8)]
    schema = "stream_id bigint, round bigint, x bigint, y bigint, on boolean, end_of_stream boolean"
    batch = spark.createDataFrame(rows, schema)
    want = sorted(tuple(r) for r in window.replay(batch, 4, 4, 3).fillna(-1).collect())
    for k, part in enumerate(([r for r in rows if r[1] < 4], [r for r in rows if r[1] >= 4], [(s, 99, 0, 0, False, True) for s in range(3)])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
    q = window.stream(source, 4, 4, 3).writeStream.format("memory").queryName("commits").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = sorted(tuple(r) for r in spark.table("commits").fillna(-1).collect())
    assert got == want


def test_csv_sink(spark, tmp_path):
    p = study.threshold_study(spark, [3], [0.01], 200)
    sinks.write_lines(sinks.threshold_lines(p), sinks.THRESHOLD_HEADER, f"{tmp_path}/csv")
    text = "".join(f.read_text() for f in tmp_path.glob("csv/*.csv"))
    assert text.startswith(sinks.THRESHOLD_HEADER) and "\n3,0.010000,3,200," in text


def test_grid_arithmetic():
    g = Grid(17, 5, 3, "3d")
    assert (g.stride_y, g.stride_z) == (32, 1024) and g.coord(g.node(16, 4, 2)) == (16, 4, 2)
    assert grids.rotated_surface(5) == Grid(4, 4, 5, "grid3d") and grids.restricted(grids.color_code(7)).width == 3
    assert grids.from_target_nodes(100_000).width == 317 and grids.to_rectangular(Grid(8, 8)) == Grid(16, 4)
    with pytest.raises(ValueError):
        Grid(2, 2, 1, "kagome")


def test_noise_is_binomial(spark):
    n = noise.uniform(spark, Grid(8, 8), 0.05, 4000).count()
    assert abs(n - 4000 * 64 * 0.05) < 5 * (4000 * 64 * 0.05) ** 0.5


def test_kernel_respects_shot_erasures(spark):
    d = spark.createDataFrame([(1, 0), (1, 2)], "shot_id bigint, node bigint")
    holes = spark.createDataFrame([(1, 1)], "shot_id bigint, node bigint")
    edges = decode.corrections(decode.decode(d, Grid(4, 4), erasures=holes)).collect()
    assert edges and all(1 not in (r.u, r.v) for r in edges)
    assert verify.remaining(d, spark.createDataFrame(edges, "shot_id bigint, u bigint, v bigint"), Grid(4, 4)).count() == 0


def test_fixture_parity(spark):
    d = tables.parity(tables.cube_toggles(spark, "/root/testdata/sf0.001"))
    assert d.groupBy("shot_id", "node").count().filter("count > 1").count() == 0 and d.filter(F.col("node") >= 448).count() == 0


def test_registered_lattice(spark):
    lattice.register("ring", lambda spark, g: spark.range(g.width).select(F.least("id", (F.col("id") + 1) % g.width).alias("u"), F.greatest("id", (F.col("id") + 1) % g.width).alias("v")))
    g = Grid(8, 1, 1, "Ring", BOUNDARIES["none"])
    d = spark.createDataFrame([(1, 0), (1, 7), (2, 3)], "shot_id bigint, node bigint")
    got = {r.shot_id: r for r in decode.decode(d, g).collect()}
    assert (got[1].u, got[1].v, got[1].n_unresolved) == ([0], [7], 0) and got[2].n_unresolved == 1
