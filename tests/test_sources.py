"""Turtle in blocks, the data source and writers in parts."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphwright.functions import vocab as v
from graphwright.sources import rdf, sinks, turtle_blocks
from graphwright.sources.turtle_blocks import scan

KEYS = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]


@pytest.fixture
def blocks(spark):
    """Files are read in blocks of a given size."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield of
    for k, x in old.items():
        spark.conf.set(k, x)


def nameless(rows):
    """Rows without the labels of blank nodes, each as often as it is there."""
    plain = lambda x: "_:" if x is not None and x.startswith("_:") else x
    return Counter(tuple(plain(x) for x in r) for r in rows)


def whole(text, name="t"):
    return nameless((r[1], r[3], r[4], r[5], r[6], r[7]) for r in dict.fromkeys(r[:8] for r in rdf.parse(text, "turtle", name)[0]))


def in_blocks(spark, path):
    return nameless(tuple(r[c] for c in KEYS) for r in rdf.read_rdf(spark, path, "turtle", split=True).collect())


def document(rng):
    """Statements over many lines with all that may mislead a reader that begins in the middle."""
    out = ["@prefix : <http://t.org/x#> . @prefix o: <http://o.org/a.b/#> .", "@base <http://t.org/x> ."]
    literals = ['"a . b"', "'it is . \\' so'", '"""one .\n@prefix : <http://no.org/> .\n"two" \'\'\' . \n:x :y :z .\n"""@en', "'''three . \"\"\" \n\n # not a comment\n'''", '"\\"\\"\\""', "1.5", "-2.", "3e4", "true", '"x"^^:type', '""', '""""""', '"""\\""""']
    for i in range(rng.randint(30, 60)):
        pick = rng.random()
        if pick < 0.08:
            out.append(rng.choice(["@prefix o: <http://o.org/%d/> ." % i, "PREFIX o: <http://o.org/%d/>" % i, "@base <http://t.org/%d/> ." % i, "prefix  q:\t<#q%d>" % i]))
        elif pick < 0.16:
            out.append("# a comment with . and \"\"\" and '''")
        else:
            parts = []
            for _ in range(rng.randint(1, 3)):
                values = [rng.choice([*literals, ":o%d" % i, "o:b.c", "<rel.x>", "_:n%d" % (i % 5), "[ :p 1 ; :q ( :a \"b .\" ) ]", "( 1 2.0 )", "[]"]) for _ in range(rng.randint(1, 3))]
                parts.append(f":p{rng.randint(0, 3)} " + rng.choice([" , ", " ,\n   "]).join(x if x != "-2." else "-2" for x in values))
            end = rng.choice([" .", " . # end . \"", "\n.", " ."])
            out.append(f":s{i} " + rng.choice([" ; ", " ;\n  "]).join(parts) + end)
    return rng.choice(["\n", "\r\n"]).join(out) + rng.choice(["", "\n"])


@pytest.mark.parametrize("seed", range(4))
def test_blocks_give_what_the_whole_file_does(spark, blocks, tmp_path, seed):
    rng = random.Random(seed)
    text = document(rng)
    (tmp_path / "a.ttl").write_bytes(text.encode())
    blocks(len(text) // rng.choice([4, 8, 15]))
    assert in_blocks(spark, f"{tmp_path}/a.ttl") == whole(text)


def test_labels_prologue_and_order_are_the_files(spark, blocks, tmp_path):
    rows = "\n".join(f"_:n :next _:n{i} ; :at {i} ." for i in range(200))
    for name in ("a", "b"):
        (tmp_path / f"{name}.ttl").write_text("@prefix : <http://t.org/x#> .\n" + rows)
    blocks(1200)
    t = rdf.read_rdf(spark, f"{tmp_path}/*.ttl", "turtle", split=True)
    assert t.select("s").distinct().count() == 2 and t.count() == 800
    one = t.where(F.endswith("graph", F.lit("a.ttl")) & (F.col("p") == "http://t.org/x#at")).orderBy("ord").collect()
    assert [int(r["o"]) for r in one] == list(range(200))


def test_files_that_do_not_split_well(spark, blocks, tmp_path):
    blocks(60)
    # a directive over several lines is read with its whole file
    text = "@prefix\n :\n\n\n\n <http://t.org/x#>\n\n\n .\n" + "".join(f":a{i} :b :c .\n" for i in range(20))
    (tmp_path / "cut.ttl").write_text(text)
    assert in_blocks(spark, f"{tmp_path}/cut.ttl") == whole(text)
    # no statement ends in most blocks
    text = "@prefix : <http://t.org/x#> .\n:a :b " + " ,\n".join(f":c{i}" for i in range(60)) + " ."
    (tmp_path / "long.ttl").write_text(text)
    assert in_blocks(spark, f"{tmp_path}/long.ttl") == whole(text)
    blocks(1000)
    for name, content in (("empty", ""), ("mark", "\ufeff@prefix : <http://t.org/x#> .\n:a :b :c .")):
        (tmp_path / f"{name}.ttl").write_bytes(content.encode())
        assert in_blocks(spark, f"{tmp_path}/{name}.ttl") == whole(content.removeprefix("\ufeff"))
    blocks(100)
    for bad in (":a :b :c .\n" * 9, "@prefix : <http://t.org/x#> .\n" + ":a :b :c .\n" * 9 + ":a :b"):
        (tmp_path / "bad.ttl").write_text(bad)
        with pytest.raises(Exception, match="prefix|no Turtle|expected"):
            in_blocks(spark, f"{tmp_path}/bad.ttl")


def test_states_of_a_block():
    assert scan('x""" . :a :b """c', "double") | {"directives": 0} == {"state": "double", "end_state": "double", "dots": True, "head": 'x""" .', "tail": ' :a :b """c', "tail_at": 6, "directives": 0, "cut": False}
    assert scan("no end\n", "single")["end_state"] == "single"
    assert scan("@prefix a: <b> . PREFIX c: <d> :x :y :z . @prefix e:", "plain")["directives"] == ["@prefix a: <b> .", "PREFIX c: <d>"] and scan("@prefix e:", "plain")["cut"]


def test_pushed_filters_and_ranges(spark, tmp_path):
    lines = [f'<http://t.org/{i}> <http://t.org/p{i % 5}> "v{i}"@en .' if i % 3 else f"<http://t.org/{i}> <http://t.org/\\u0070{i % 5}> <http://t.org/{i + 1}> ." for i in range(300)]
    (tmp_path / "a.nt").write_text("\n".join(lines))
    spark.dataSource.register(rdf.RdfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda push: spark.read.format("rdf").option("path", f"{tmp_path}/a.nt").option("rangebytes", "3000").option("pushdown", push).load()
        plain = spark.createDataFrame([tuple(r) for r in read("false").collect()], rdf.TRIPLES)
        assert plain.count() == 300
        for test in ("p = 'http://t.org/p2'", "p in ('http://t.org/p1', 'http://t.org/p3') and o_kind = 'uri'", "o_lang is not null and s like 'http://t.org/1%'", "p = 'none'", "o_lang is null and length(o) > 14"):
            got = read("true").where(test)
            assert sorted(map(str, got.drop("ord").collect())) == sorted(map(str, plain.where(test).drop("ord").collect()))
        plan = lambda push: read(push).where("p = 'http://t.org/p2' and o_kind = 'literal'")._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" in plan("false") and "Filter (" not in plan("true")
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_documents_in_parts(spark, tmp_path):
    rows = [(f"http://t.org/{i % 40}", v.LABEL if i % 2 else f"http://p{i % 3}.org/x/q.r", f'v "{i}" \\ \n\r\t <&> é', "literal", None, "en" if i % 4 else None) for i in range(200)]
    rows += [("http://t.org/hub", "http://p.org/has", f"http://t.org/{i}", "uri", None, None) for i in range(300)] + [("http://t.org/0", v.TYPE, v.CLASS, "uri", None, None), ("http://t.org/0", "http://p.org/n", "7", "literal", v.XSD + "int", None)]
    t = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for syntax in ("turtle", "xml"):
            sinks.write_parts(t, f"{tmp_path}/{syntax}", syntax, {"p": "http://p.org/"})
            files = [f for f in (tmp_path / syntax).iterdir() if f.name.startswith("part-") and f.stat().st_size]
            assert len(files) > 2 and all(("@prefix p:" in f.read_text()) if syntax == "turtle" else "xmlns:p=" in f.read_text() for f in files)
            back = rdf.read_rdf(spark, f"{tmp_path}/{syntax}", syntax).select(KEYS)
            assert back.exceptAll(t).isEmpty() and t.exceptAll(back).isEmpty()
        sinks.save(t, f"{tmp_path}/saved.ttl", parts=True)
        assert rdf.read_rdf(spark, f"{tmp_path}/saved.ttl", "turtle").count() == t.count()
        spark.dataSource.register(rdf.RdfSource)
        out = f"{tmp_path}/made"
        for _ in range(2):
            sinks.by_subject(t).write.format("rdf").mode("overwrite").option("path", out).option("syntax", "xml").save()
        back = spark.read.format("rdf").option("path", f"{out}/part-*").load().select(KEYS)
        assert back.exceptAll(t).isEmpty() and t.exceptAll(back).isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    with pytest.raises(ValueError, match="blank"):
        sinks.write_parts(spark.createDataFrame([("_:a", "p", "o", "uri")], "s string, p string, o string, o_kind string"), f"{tmp_path}/no")
    odd = spark.createDataFrame([("http://t.org/a", "http://p.org/1", "x", "literal")], "s string, p string, o string, o_kind string")
    with pytest.raises(Exception, match="no name for the predicate"):
        sinks.write_parts(odd, f"{tmp_path}/no", "xml")


def test_table_function(spark):
    spark.udtf.register("parse_rdf", rdf.parse_rdf_table())
    docs = spark.createDataFrame([(1, "@prefix : <http://t.org/> . :a :b :c , 2 .", "turtle"), (2, None, "turtle"), (3, '<http://t.org/a> <http://t.org/b> "x"@EN .', "nt"), (4, "", "turtle")], "id int, text string, syntax string")
    docs.createOrReplaceTempView("rdf_docs")
    got = spark.sql("SELECT id, t.p, t.o, t.o_kind, t.o_lang FROM rdf_docs, LATERAL parse_rdf(text, syntax, '') t").collect()
    assert sorted(tuple(r) for r in got) == [(1, "http://t.org/b", "2", "literal", None), (1, "http://t.org/b", "http://t.org/c", "uri", None), (3, "http://t.org/b", "x", "literal", "en")]


def test_directives_that_change_nothing_do_not_add_up(spark, tmp_path, monkeypatch):
    """Every statement may state its prefixes again; one that changes counts from there on."""
    monkeypatch.setattr(turtle_blocks, "MOST_DIRECTIVES", 8)
    again = lambda i: ("@prefix a: <http://t.org/{}/> . ", "PREFIX a: <http://t.org/{}/>\n")[i % 3 == 0]
    text = "".join(again(i).format(i // 50) + f'a:s{i} a:p """line\nline {i}""" .\n' for i in range(200))
    (tmp_path / "a.ttl").write_text(text)
    got = nameless(tuple(r[c] for c in KEYS) for r in rdf.read_rdf(spark, f"{tmp_path}/a.ttl", "turtle", split=True, block="500").collect())
    assert got == whole(text)
    base = ["@prefix a: <b> .", "@base <http://x.org/> .", "@prefix a: <b> .", "PREFIX a: <b>"]
    assert turtle_blocks.changes(base) == base[:3]


def test_size_of_blocks_does_not_set_the_number_of_tasks(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("".join(f"<http://t.org/s{i}> <http://t.org/p> {i} .\n" for i in range(3000)))
    spark.sparkContext.setJobGroup("many blocks", "")
    assert rdf.read_rdf(spark, f"{tmp_path}/a.ttl", "turtle", split=True, block="500").count() == 3000
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup("many blocks") for i in tracker.getJobInfo(j).stageIds]
    assert max(x.numTasks for x in stages if x) <= 32


def test_documents_of_a_large_graph_stay_small(spark, monkeypatch):
    monkeypatch.setattr(sinks, "PART_TRIPLES", 100)
    t = spark.range(5000).selectExpr("concat('http://t.org/s', id) as s", "'http://t.org/p' as p", "'x' as o", "'literal' as o_kind")
    sizes = [r["n"] for r in sinks.by_subject(t).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 30 and max(sizes) < 400 and sum(sizes) == 5000


def test_documents_of_a_small_file_are_parsed_by_several_tasks(spark, monkeypatch):
    from graphwright import source_queries

    monkeypatch.setattr(source_queries, "DOCUMENTS", 50, raising=False)
    parsed = source_queries.parse_rdf_rows(spark, "/root/testdata/sf0.001")
    assert parsed.groupBy(F.spark_partition_id()).count().count() > 1
