"""Queries against their SQL on the smallest tables, and library behaviour on hand-made inputs."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import weftgraph.suite  # noqa: F401
from weftgraph import catalogue
from weftgraph.functions import extract, terms
from weftgraph.operators import graphstats, resolve, rules
from weftgraph.operators import triples as tr
from weftgraph.plans import bgp, mapping, sparql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or a few of each kind; the driver compares all of them.
COMPARED = [
    "pct_encode", "fold_text", "normalize_answer", "abbrev_inline", "abbrev_expand", "match_select", "chat_exchanges", "html_text", "storyboard_score",
    "split_811", "stratified_split", "oversample", "answer_cap", "qa_metrics", "cls_metrics_strict", "length_stats", "likert_bucket", "sync_diff",
    "canonicalize", "rml_array", "facts_scan", "rule_context", "grounding_parse", "head_body_anti", "amie_parse", "stream_session", "csv_roundtrip",
    "bgp_category_counts", "user_trace", "missing_links",
]


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_small}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, duck, sf_small, name):
    df = catalogue.QUERIES[name](spark, sf_small)
    found = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.collect(), df.columns) == rows_of(found.fetchall(), columns)


def graph(spark, rows):
    return spark.createDataFrame([(*r, "literal" if r[1] == "label" else "iri") for r in rows], "s string, p string, o string, o_kind string")


def test_patterns(spark):
    g = graph(spark, [("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "c"), ("a", "label", "A"), ("b", "likes", "a")])
    assert {tuple(r) for r in bgp.match(g, [("?x", "knows", "?y"), ("?y", "knows", "?z")]).select("x", "y", "z").collect()} == {("a", "b", "c"), ("b", "c", "c"), ("c", "c", "c")}
    assert [r.x for r in bgp.match(g, [("?x", "knows", "?x")]).collect()] == ["c"]
    assert {r.p for r in bgp.match(g, [("a", "?p", "?o")]).collect()} == {"knows", "label"}
    with pytest.raises(ValueError):
        bgp.match(g, [("?x", "knows", "?y"), ("?u", "likes", "?v")])
    out = sparql.query(g, 'SELECT ?x ?l WHERE { ?x <knows> ?y OPTIONAL { ?x <label> ?l } FILTER(?x != "c") FILTER NOT EXISTS { ?x <likes> ?z } }')
    assert [tuple(r) for r in out.collect()] == [("a", "A")]
    union = sparql.query(g, "PREFIX : <> SELECT DISTINCT ?x WHERE { { ?x :likes ?y } UNION { ?x :label ?y } } ORDER BY ?x")
    assert [r.x for r in union.collect()] == ["a", "b"]
    counted = sparql.query(g, "SELECT ?x (COUNT(DISTINCT ?y) AS ?n) WHERE { ?x <knows>/<knows> ?y } GROUP BY ?x HAVING(COUNT(?y) >= 1) ORDER BY DESC(?n) ?x LIMIT 2")
    assert [tuple(r) for r in counted.collect()] == [("a", 1), ("b", 1)]


def test_query_semantics(spark):
    g = graph(spark, [("a", "v", "2"), ("a", "w", "3"), ("b", "v", "5"), ("b", "w", "3"), ("c", "v", "7")])
    q = lambda text: sorted(tuple(r) for r in sparql.query(g, text).collect())
    assert q("SELECT ?x (1 + 2 * 3 AS ?n) WHERE { ?x <w> ?y }") == [("a", 7.0), ("b", 7.0)]
    assert q("SELECT ?x ((1 + 2) * 3 AS ?n) WHERE { ?x <w> ?y FILTER((?y + 1) * 2 = 8) }") == [("a", 9.0), ("b", 9.0)]
    assert q("SELECT ?x ?z WHERE { ?x <v> ?y OPTIONAL { ?x <w> ?z FILTER(?y < ?z) } }") == [("a", "3"), ("b", None), ("c", None)]
    assert q("SELECT ?x WHERE { ?x <v> ?y FILTER NOT EXISTS { ?x <w> ?z FILTER(?z < ?y) } }") == [("a",), ("c",)]
    assert q("SELECT ?x ?y WHERE { ?x <v> ?y VALUES (?x ?y) { (<a> \"2\") (<b> \"9\") (<c> UNDEF) } }") == [("a", "2"), ("c", "7")]


def test_graph_of_apart_mappings_is_a_set(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "id int, name string")
    one = mapping.TripleMap("t", mapping.Template("a/{id}"), "A", (("label", mapping.Literal("name")),))
    same = mapping.TripleMap("t", mapping.Template("a/{id}"), None, (("label", mapping.Literal("name")),))
    two = mapping.TripleMap("t", mapping.Template("b/{id}_{name}"), "B")  # two places, one of them text: not one to one
    want = {("a/1", "type", "A"), ("a/2", "type", "A"), ("a/1", "label", "x")}
    for specs, extra in (([one], set()), ([one, same], set()), ([one, two], {("b/1_x", "type", "B")})):
        got = [(r.s, r.p, r.o) for r in mapping.graph(specs, {"t": rows}).collect()]
        assert len(got) == len(set(got)) and set(got) == want | extra


def test_triples(spark):
    lines = spark.createDataFrame([('<http://x/a> <http://x/p> "say \\"hi\\"\\n\\u00e9"@en .',), ("# comment",), ("",), ("<http://x/a> <http://x/q> _:b1 .",)], "value string")
    rows = {(r.p, r.o, r.o_kind, r.o_lang) for r in tr.parse_nt(lines).collect()}
    assert rows == {("http://x/p", 'say "hi"\né', "literal", "en"), ("http://x/q", "_:b1", "iri", None)}
    with pytest.raises(Exception, match="bad N-Triples line"):
        tr.parse_nt(spark.createDataFrame([("<a> nonsense",)], "value string")).collect()
    g = graph(spark, [("a", "p", "b"), ("x", "p", "b"), ("a", "label", "a")])
    merged = tr.remap(g, spark.createDataFrame([("a", "x")], "old string, new string"))
    assert {(r.s, r.p, r.o) for r in merged.collect()} == {("x", "p", "b"), ("x", "label", "a")}
    assert {(r.s, r.p, r.o) for r in tr.reverse(g, {"p": "inv"}).collect()} == {("b", "inv", "a"), ("b", "inv", "x")}


def test_mapping_fails_on_missing_columns(spark):
    spec = mapping.TripleMap("t", mapping.Template("x/{id}"), "X", (("label", mapping.Literal("name")),))
    with pytest.raises(ValueError, match="name"):
        mapping.triples(spec, {"t": spark.createDataFrame([(1,)], "id int")})
    rows = mapping.triples(spec, {"t": spark.createDataFrame([(1, None), (2, "b c")], "id int, name string")}).collect()
    assert {(r.s, r.p, r.o) for r in rows} == {("x/1", "type", "X"), ("x/2", "type", "X"), ("x/2", "label", "b c")}


def test_rules(spark):
    g = graph(spark, [("u1", "nation", "n1"), ("u2", "nation", "n1"), ("n1", "region", "r1"), ("u1", "region", "r1")])
    body, head = rules.parse_rule("?u nation ?n ?n region ?r => ?u region ?r")
    assert {(r.u, r.r) for r in rules.groundings(g, body, head).collect()} == {("u1", "r1")}
    assert {(r.u, r.label) for r in rules.labelled(g, body, head).collect()} == {("u1", "yes"), ("u2", "no")}
    q = rules.quality(g, body, head).first()
    assert (q.support, q.body_size, q.pca_body_size, q.std_confidence, q.pca_confidence) == (1, 2, 1, 0.5, 1.0)
    mined = dict(rules.mine(g, ["nation", "region"]))
    assert "?a nation ?c ?c region ?b => ?a region ?b" in mined


def test_resolution_and_text(spark):
    forms = spark.createDataFrame([("Heart Attack",), ("heart-attacks",), ("Mass",), ("gas",)], "f string")
    assert {r.f: r.root for r in resolve.canonical_keys(forms, "f").collect()} == {"Heart Attack": "heart attack", "heart-attacks": "heart attack", "Mass": "mass", "gas": "gas"}
    row = spark.createDataFrame([("Straße  X", "a+b c")], "a string, b string")
    out = row.select(terms.fold("a").alias("f"), terms.pct_decode(terms.pct_encode("b")).alias("b"), extract.spell_initialisms(F.lit("an MRI of XMRI"), ["MRI"]).alias("m")).first()
    assert tuple(out) == ("strasse x", "a+b c", "an M R I of XMRI")


def test_graph_statistics(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("z", "z")], "a string, b string")
    assert {r.node: r.component for r in graphstats.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    assert {r.node: r.clustering for r in graphstats.clustering(e).collect()} == {"a": 1.0, "b": 1.0, "c": 0.333333, "d": 0.0, "x": 0.0, "y": 0.0}
    assert {r.node: r.degree for r in graphstats.degrees(e).collect()}["z"] == 2


def test_closure_has_no_depth_limit(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)] + [("x", "y"), ("y", "x"), (None, "z")], "child string, parent string")
    got = {(r.child, r.ancestor) for r in bgp.closure(chain).collect()}
    assert len(got) == 820 + 4 and ("n0", "n40") in got and ("x", "x") in got
    assert bgp.closure(chain.limit(0)).count() == 0


def test_components_that_do_not_settle_are_an_error(spark):
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)], "a string, b string")
    assert {r.component for r in graphstats.components(edges).collect()} == {"000"}
    with pytest.raises(RuntimeError):
        graphstats.components(edges, rounds=1)


def streamed(spark, rows, folder, make, name, mode):
    rows.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


@pytest.mark.parametrize(("name", "mode"), [("tumbling", "complete"), ("sliding", "complete"), ("sessions", "complete"), ("distinct_events", "append")])
def test_streams_equal_batch(spark, sf_small, tmp_path, name, mode):
    from weftgraph.streaming import counts

    batch = spark.read.parquet(f"{sf_small}/events.parquet")
    make = getattr(counts, name)
    assert streamed(spark, batch, str(tmp_path / "in"), make, name, mode) == {tuple(r) for r in make(batch).collect()}


def test_late_rows(spark, tmp_path):
    from weftgraph.streaming import counts

    times = ["2026-01-01 00:00:00", "2026-01-02 12:00:00", "2026-01-02 10:59:59", "2026-01-02 11:00:00", None]
    rows = spark.createDataFrame([(i, t, 1, "a", 1.0) for i, t in enumerate(times)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [(r.event_id, r.behind) for r in counts.late_rows(rows).collect()] == [(2, 3601.0)]
    # the same rule in a stream: a second file that begins before the first one's watermark gives no window any more
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows.filter("event_id < 2"), rows.filter("event_id = 0")):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        counts.tumbling(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert [r.n for r in spark.read.parquet(out).collect()] == [1]


def test_triples_are_upserted_once(spark, tmp_path):
    from weftgraph.streaming import counts

    path = str(tmp_path / "triples")
    assert counts.read_triples(spark, path) is None
    write = counts.upsert_triples(path)
    first = spark.createDataFrame([("a", "p", "b"), ("a", "p", "b"), ("a", "p", "c")], "s string, p string, o string")
    write(first, 0)
    write(first.union(spark.createDataFrame([("x", "p", "c")], first.schema)), 1)
    write(first.union(spark.createDataFrame([("x", "p", "c")], first.schema)), 1)  # run again after a failure
    assert sorted(tuple(r) for r in counts.read_triples(spark, path).collect()) == [("a", "p", "b", 0), ("a", "p", "c", 0), ("x", "p", "c", 1)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "s string, p string, o string, o_kind string")
    assert bgp.match(empty, [("?x", "p", "?y")]).count() == 0
    assert graphstats.components(spark.createDataFrame([], "a string, b string")).count() == 0


# --- readers, writers, hooks ---------------------------------------------------------------------------


def test_readers(spark, tmp_path):
    from weftgraph.sources import files

    path = tmp_path / "in"
    (path / "sub").mkdir(parents=True)
    (path / "t.csv").write_text("a;b\n1;null\n;x\n")
    assert [tuple(r) for r in files.read_table(spark, str(path / "t.csv"), ["a", "b"], ";").collect()] == [("1", "null"), (None, "x")]
    with pytest.raises(ValueError, match="lacks c"):
        files.read_table(spark, str(path / "t.csv"), ["c"], ";")
    assert files.read_prior(spark, str(path / "none.csv"), ["a"]).count() == 0
    (path / "x.nt").write_bytes('<a> <p> "caf\u00e9\none\\"two" .\r\n# it\'s "open\n<b> <p> <c> .\n'.encode("cp1252"))
    assert [r.value for r in files.read_nt_files(spark, str(path)).collect()] == ['<a> <p> "café\\none\\"two" .', '# it\'s "open', "<b> <p> <c> ."]
    got = files.parse_turtle('@prefix : <http://x/> . @base <http://b/> .\n:a a :C ; :p "x \\"y\\""@en , 3 ; :q [ :r <d> ] ; :l ( :m :n ) .')
    assert set(got) == {("http://x/a", f"{files.RDF}type", "http://x/C"), ("http://x/a", "http://x/p", 'x "y"'), ("http://x/a", "http://x/p", "3"), ("http://x/a", "http://x/q", "_:b1"), ("_:b1", "http://x/r", "http://b/d"), ("http://x/a", "http://x/l", "http://x/m"), ("http://x/a", "http://x/l", "http://x/n")}
    with pytest.raises(ValueError):
        files.parse_turtle(":a :b ^ .")
    assert files.json_records('[{"a": 1}]') == files.json_records('{"a": 1}') == ['{"a": 1}'] and files.json_records("[1]") is None


def test_documents(spark, tmp_path):
    import zipfile

    from weftgraph.sources import files

    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("P: ask", "more", "O: reply", ""))
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
    rows = files.read_paragraphs(spark, str(tmp_path)).select("paragraph", *(c.alias(n) for n, c in zip(("role", "rest"), files.speaker("text"), strict=True)))
    assert [tuple(r) for r in rows.orderBy("paragraph").collect()] == [(0, "user", "ask"), (1, None, "more"), (2, "assistant", "reply"), (3, None, "")]


def test_repairs(spark):
    from difflib import SequenceMatcher

    from weftgraph.functions import repair

    assert repair.mend("f\u00c3\u00bchlte  &amp; so") == "fühlte & so"
    assert repair.mend("fühlte") == "fühlte" and repair.mend(None) is None
    assert repair.list_items("['a', ' b ', '']") == ["a", "b"] and repair.list_items("nonsense(") is None and repair.list_items("5") == ["5"]
    rows = spark.createDataFrame([("Heart  attack", "heart attacks"), ("a", None), ("", "")], "a string, b string")
    plain = lambda x: " ".join((x or "").casefold().split())
    assert [r.s for r in rows.select(repair.similarity("a", "b").alias("s")).collect()] == [round(SequenceMatcher(None, plain(r.a), plain(r.b)).ratio(), 4) for r in rows.collect()]


def test_storyboard_scores(spark):
    import json

    from weftgraph.functions import scoring

    scene = {"scene_number": 1, "narration": "Brief narration.", "visual_description": "Simple diagram.", "on_screen_text": "Example"}
    whole = {"title": "Example", "scenes": [scene]}
    less = {"title": "Example", "scenes": [{k: v for k, v in scene.items() if k != "on_screen_text"}]}
    texts = [json.dumps(whole), "Here is the output:\n```json\n" + json.dumps(whole) + "\n```", json.dumps(less), "**Scene 1**\nNarration: Hello.\nVisual description: A diagram.\nOn-screen text: Hello.", "Unrelated text", json.dumps(whole)[:-2], json.dumps({**whole, "scenes": [{**scene, "scene_number": True}]}), None]
    rows = spark.createDataFrame([(i, t, "Write two scenes") if i == 0 else (i, t, None) for i, t in enumerate(texts)], "id int, text string, request string")
    got = {int(r.id): r for r in scoring.storyboard(rows).collect()}
    assert [got[i].strict for i in range(8)] == [True, False, False, False, False, False, False, False]
    assert [got[i].completeness for i in (0, 1, 3, 4, 7)] == [1, 1, 0.4, 0, 0] and 0 < got[2].completeness < 1 and got[1].wrapped
    assert "scene 1: on_screen_text" in got[2].errors and "scene 1: scene_number" in got[6].errors
    assert (got[0].fitness, got[1].fitness) == (0.5, 0.5)  # one scene where two were asked for; strict and wrapped


def test_sampling_and_search_loops(spark):
    from weftgraph.operators import datasets as ds

    found = ds.bandit({"bad": [0.0, 0.1], "good": [0.9, 1.0], "fair": [0.5]}, 200, 0.5)
    assert max(found, key=lambda x: x[1])[0] == "good" and sum(n for _, n, _ in found) == 200
    with pytest.raises(ValueError):
        ds.bandit({"a": [1], "b": [1]}, 1)
    history = ds.elitist(["a", "bb", "c"], len, lambda p, g, i: p + "x", generations=4, elite=1)
    assert [h[0][0] for h in history] == sorted(h[0][0] for h in history) and history[-1][0][0] > 2
    rows = spark.createDataFrame([(i, int(i < 5)) for i in range(40)], "id int, y int")
    some = ds.balanced(rows, "y", "id", 30, seed=1).collect()
    assert len(some) == 30 and sum(r.y for r in some) == 5  # five of the rarer label, the rest filled
    with pytest.raises(Exception, match="not in"):
        ds.METRICS["bad"] = lambda: F.lit(2.0)
        ds.weighted_score(rows.selectExpr("'x' as output", "'x' as example"), {"bad": 1.0}).collect()
    ds.METRICS.pop("bad")
    p = spark.range(1).select(ds.sign_test(F.lit(3), F.lit(0)).alias("a"), ds.sign_test(F.lit(2), F.lit(3)).alias("b"), *(c.alias(n) for n, c in zip("lh", ds.wilson(F.lit(0), F.lit(164)), strict=True))).first()
    assert (round(p.a, 6), round(p.b, 6), round(p.l, 6), round(p.h, 4)) == (0.25, 1.0, 0.0, 0.0229)


def test_negatives_are_never_neighbours(spark):
    edges = spark.createDataFrame([("hub", f"t{i}") for i in range(30)] + [("all", f"t{i}") for i in range(31)] + [(f"s{i}", "t30") for i in range(5)], "a string, b string")
    got = {r.start: r.negative for r in graphstats.negatives(edges, seed=3).collect()}
    assert got["hub"] == "t30" and got.get("all") is None and all(got[f"s{i}"] != "t30" for i in range(5))


def test_centralities(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "e")], "a string, b string")
    got = {r.node: (r.betweenness, r.stress) for r in graphstats.centralities(e).collect()}
    assert got == {"a": (1.0, 2.0), "b": (0.5, 1.0), "c": (1.0, 2.0), "d": (3.5, 5.0), "e": (0.0, 0.0)}


def brute_paths(edges):
    """{(a, b): (distance, number of shortest paths)} of all ordered pairs."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        far, ways, front = {s: 0}, {s: 1}, [s]
        while front:
            new = {}
            for x in front:
                for y in near[x]:
                    if y not in far:
                        new[y] = new.get(y, 0) + ways[x]
            far |= dict.fromkeys(new, far[front[0]] + 1)
            ways |= new
            front = list(new)
        out |= {(s, t): (far[t], ways[t]) for t in far if t != s}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_of_graphs_with_leaves(spark, seed):
    import collections
    import random

    rnd = random.Random(seed)
    edges = [(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(18)] + [(f"n{rnd.randrange(5)}", f"leaf{i}") for i in range(15)]
    edges += [("p", "q"), ("m", "u0"), ("u1", "m"), ("m", "u2"), ("x", "x")]  # a lone edge, a star, a lone loop
    df, p = spark.createDataFrame(edges, "a string, b string"), brute_paths(edges)
    assert {r.d: r.pairs for r in graphstats.distance_counts(df).collect()} == collections.Counter(d for d, _ in p.values())
    top = max(d for d, _ in p.values())
    want = {}
    for v in {a for a, _ in p}:
        d = [x for (a, _), (x, _) in p.items() if a == v]
        through = [(p[a, v][1] * p[v, b][1], n) for (a, b), (x, n) in p.items() if a < b and v not in (a, b) and (a, v) in p and (v, b) in p and p[a, v][0] + p[v, b][0] == x]
        want[v] = (len(d) / sum(d), sum(top + 1 - x for x in d) / len(d) / top, sum(m / n for m, n in through), sum(m for m, _ in through))
    got = {r.node: tuple(r)[1:] for r in graphstats.centralities(df).collect()}
    assert got.keys() == want.keys()
    for v, x in want.items():
        assert got[v] == pytest.approx(x, abs=2e-6), v


def test_paths_of_a_star_need_no_row_for_each_pair(spark):
    n = 20_000
    star = spark.range(n).select(F.lit("hub").alias("a"), F.concat(F.lit("leaf"), "id").alias("b"))
    assert {r.d: r.pairs for r in graphstats.distance_counts(star).collect()} == {1: 2 * n, 2: n * (n - 1)}
    got = {r.node: tuple(r)[1:] for r in graphstats.centralities(star).collect()}
    assert len(got) == n + 1 and got["hub"] == (1.0, 1.0, n * (n - 1) / 2, n * (n - 1) / 2) and got["leaf7"][2:] == (0.0, 0.0)
    none = spark.createDataFrame([], "a string, b string")
    assert graphstats.distance_counts(none).count() == graphstats.centralities(none).count() == 0


def test_nt_scan_shuffles_nothing_and_compresses(spark, duck, sf_small):
    df = catalogue.QUERIES["nt_scan"](spark, sf_small)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.inputFiles() and all(f.endswith(".gz") for f in df.inputFiles())
    found = duck.execute(catalogue.ORACLES["nt_scan"])
    assert rows_of(df.collect(), df.columns) == rows_of(found.fetchall(), [d[0] for d in found.description])
    lines = spark.createDataFrame([("<a> <b> <c> .",), ("<a>  <b> <c>.",)], "value string")
    assert tr.parse_nt(lines).count() == 1


def test_named_components_move_hashes(spark, monkeypatch):
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "c"), ("z", "y"), ("l", "l"), ("a", "a"), ("y", "x"), ("d", "c")], "a string, b string")
    want = {**dict.fromkeys("abcd", "a"), **dict.fromkeys("xyz", "x"), "l": "l"}
    kinds, plain = [], graphstats.components
    monkeypatch.setattr(graphstats, "components", lambda e, *a: kinds.append(e.schema["a"].dataType.typeName()) or plain(e, *a))
    got = graphstats.named_components(edges)
    assert {r.node: r.component for r in got.collect()} == want and got.count() == 8
    same = F.length  # hashes that collide: the names are taken
    monkeypatch.setattr(graphstats.F, "xxhash64", lambda c: same(c).cast("long"))
    got = graphstats.named_components(edges)
    assert {r.node: r.component for r in got.collect()} == want and got.count() == 8
    assert kinds == ["long", "string"]


def test_stars_are_the_iri_edges_of_the_graph(spark):
    rows = spark.createDataFrame([(1, "x y", [3, None, 3], 7), (1, "", [], 8), (2, None, None, 7), (None, "x", [4], 7), (3, None, None, None)], "id int, name string, parts array<int>, up long")
    ups = spark.createDataFrame([(7, "p+q"), (7, "r"), (9, "s")], "k long, n string")
    parent = mapping.TripleMap("ups", mapping.Template("up/{n}"), "Up")
    pairs = (("label", mapping.Literal("name")), ("named", mapping.Template("name/{name}")), ("root", mapping.Constant("world")), ("has", mapping.Each("parts", "part/{it}")), ("up", mapping.Reference(parent, "up", "k")))
    specs, tables = [mapping.TripleMap("t", mapping.Template("a/{id}"), "A", pairs), parent], {"t": rows, "ups": ups}
    want = {(r.s, r.o) for r in mapping.graph(specs, tables).filter("p <> 'type' and o_kind = 'iri'").collect()}
    got = mapping.stars(specs, tables)
    assert {(r.node, o) for r in got.collect() for o in r.near if o is not None} == want and ("a/1", "name/x%20y") in want and ("a/1", "up/p%2Bq") in want
    with pytest.raises(ValueError, match="no column"):
        mapping.stars(specs, tables | {"t": rows.drop("parts")})


@pytest.mark.parametrize("chunk", [4_000_000, 0])
def test_linked_components(spark, monkeypatch, chunk):
    import random

    monkeypatch.setattr(graphstats, "CHUNK_EDGES", chunk)  # 0: the driver takes no one-task step
    random.seed(5)
    n, least = 300, {}
    pairs = [(i, i + 1) for i in range(60)] + [(200, 200)] + [tuple(random.sample(range(61, 200), 2)) for _ in range(70)] + [(201 + i % 7 * 9, 202 + i) for i in range(90)]
    group = list(range(n))
    for a, b in pairs:
        old, new = group[a], group[b]
        group = [new if g == old else g for g in group]
    name = lambda i: f"é{i:03}"
    for i in sorted({x for p in pairs for x in p}):
        least.setdefault(group[i], name(i))
    want = {name(i): least[group[i]] for p in pairs for i in p}
    random.shuffle(pairs)
    rows = [(name(a), [name(b)]) for a, b in pairs] + [(name(0), [name(5), None, name(1), name(0)])] * 2
    rows += [(None, [name(299), name(1)]), (name(298), []), (name(297), [None])]  # no nodes
    got = graphstats.linked_components(spark.createDataFrame(rows, "node string, near array<string>").repartition(40))
    assert sorted(map(tuple, got.collect())) == sorted(want.items())
    assert graphstats.linked_components(spark.createDataFrame([], "node string, near array<string>")).count() == 0


def test_components_read_the_responses_once(spark, duck, sf_small, monkeypatch):
    plans, saved = [], graphstats.shared.saved
    monkeypatch.setattr(graphstats.shared, "saved", lambda df, path: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or saved(df, path))
    df = catalogue.QUERIES["components"](spark, sf_small)
    found = duck.execute(catalogue.ORACLES["components"])
    assert rows_of(df.collect(), df.columns) == rows_of(found.fetchall(), [d[0] for d in found.description])
    assert sum(p.count("Relation [l_orderkey") for p in plans) == 1
