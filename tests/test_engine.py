"""Units, temporal values, requests, search, history, terminology, validation, formats and streams."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkclin.functions import text as tx
from sparkclin.functions import units
from sparkclin.functions.temporal import add, compare, parse_temporal, search_range
from sparkclin.operators import hierarchy, history, indexing, terminology
from sparkclin.operators.search import Search, Store, number_range, version_key
from sparkclin.operators.validation import differential, expand_choice, merge_element, snapshot, unknown_elements
from sparkclin.plans.catalog import Catalog, SearchError
from sparkclin.plans.request import parse_condition, parse_filter, parse_request, parse_text_query, split_escaped, split_prefix
from sparkclin.sources import formats


def test_units():
    assert units.convert(Decimal(1), "min", "s") == 60
    assert units.convert(Decimal(1), "dL", "L") == Decimal("0.1")
    assert units.convert(Decimal(120), "mm[Hg]", "Pa") == Decimal("15998.640")
    assert round(units.convert(Decimal(37), "Cel", "[degF]"), 6) == Decimal("98.6")
    assert units.comparable("mg/dL", "g/L") and not units.comparable("mg", "mL")
    assert units.parse_unit("kg.m/s2").dims == units.parse_unit("N").dims
    assert units.parse_unit("{cells}/uL").dims == units.parse_unit("/L").dims
    for bad in ("m..s", "é", "", "xyz", "m/", "(m"):
        with pytest.raises(units.UnitError):
            units.parse_unit(bad)


def test_temporal():
    t = parse_temporal
    assert compare(t("2020"), t("2020-01")) is None and compare(t("2019"), t("2020-01")) == -1
    assert compare(t("2020-01-01T10:00:00Z"), t("2020-01-01T10:00:00")) is None
    assert add(t("2020-01-31"), Decimal(1), "month").text() == "2020-02-29"
    assert t("2020-13") is None and t("2020-02-30") is None and t("10:61") is None
    assert search_range("2020-12") == ("2020-12-01 00:00:00", "2021-01-01 00:00:00")
    assert search_range("2020-01-01T10:00+02:00") == ("2020-01-01 08:00:00", "2020-01-01 08:01:00")


def test_request_parsing():
    assert split_escaped(r"a\,b,c", ",") == ["a,b", "c"]
    assert split_prefix("ge2020") == ("ge", "2020") and split_prefix("general") == ("eq", "general")
    c = parse_condition("subject:Patient.name:exact", "x,y")
    assert (c.code, c.target, c.chain, c.values) == ("subject", "Patient", ("name:exact",), ("x", "y"))
    assert parse_condition("_has:Observation:patient:code", "1").reverse == (("Observation", "patient"),)
    r = parse_request("Patient?name=a&_sort=-name,birthdate&_count=5000&_include=A:b&_elements=x,y")
    assert r.sort == [("name", True), ("birthdate", False)] and r.count == 1000 and r.include == ["A:b"] and r.elements == ["x", "y"]
    assert parse_filter('name co "a b" and not (x gt 1 or y pr true)')[0] == "and"
    assert parse_text_query('a (b OR "c d") NOT e')[0] == "and"
    assert number_range("100") == (Decimal(100), Decimal("99.5"), Decimal("100.5"))
    for bad in ("name eq", "(a eq b", "a xx b"):
        with pytest.raises(SearchError):
            parse_filter(bad)


def test_search_rejects(spark, sf):
    s = Search(Store.from_tables(spark, sf, "Patient"))
    for url in ("Patient?nothing=1", "Patient?balance:exact=1", "Patient?balance=x", "Nothing?name=1"):
        with pytest.raises(SearchError):
            s.matches(url)


def test_paging_walks_through_all(spark, sf):
    s = Search(Store.from_tables(spark, sf, "Patient"))
    url, seen = "Patient?_sort=segment,-balance&_count=40", []
    while url:
        b = s.bundle(url)
        seen += [e["resource"]["id"] for e in b["entry"]]
        url = next((x["url"] for x in b["link"] if x["relation"] == "next"), None)
    want = [r.id for r in s.sort_keys(s.matches("Patient"), "Patient", [("segment", False), ("balance", True)])[0].orderBy("sort_0", F.desc("sort_1"), "sort_id").collect()]
    assert seen == want and len(set(seen)) == 150
    assert s.bundle("Patient?_summary=count&active=true")["total"] == s.matches("Patient?active=true").count()


def test_index_round_trip(spark, sf, tmp_path):
    store = Store.from_tables(spark, sf, "Encounter")
    index = indexing.index_all(store.resources("Encounter"), store.catalog.of_type("Encounter"))
    indexing.write_index(index, str(tmp_path))
    again = Search(Store(store.frames, index_path=str(tmp_path)))
    url = "Encounter?status=F&total=gt100000&subject=Patient/7,Patient/8"
    assert sorted(r.id for r in again.matches(url).collect()) == sorted(r.id for r in Search(store).matches(url).collect())
    plan = again.matches("Encounter?status=F")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [" in plan


def test_extraction_shapes(spark):
    df = spark.createDataFrame([("Patient", "1", 1)], "resource_type string, id string, version_id bigint")
    df = df.withColumn("resource", F.from_json(F.lit('{"d":["2020","2020-05","2020-05-06","2020-05-06T10:00:00Z"],"r":["Patient/1","http://x/Patient/2/_history/3","#c","http://v|1.2","abc"]}'), "d array<string>, r array<string>"))
    from sparkclin.plans.catalog import SearchParam

    d = indexing.shred(df, [SearchParam("d", "Patient", "date", "d")]).orderBy("start_date", F.desc("end_date")).collect()
    assert [(str(x.start_date), str(x.end_date)) for x in d][0] == ("2020-01-01 00:00:00", "2021-01-01 00:00:00") and len(d) == 4
    r = {x.reference_kind: x for x in indexing.shred(df, [SearchParam("r", "Patient", "reference", "r")]).collect()}
    assert r["absolute"].target_version_id == "3" and r["canonical"].canonical_version == "1.2" and "fragment" in r
    assert [x.p for x in spark.range(1).select(F.explode(indexing.family_parts(F.lit("van der-Berg, Jr.")).alias("p")).alias("p")).collect()] == ["van", "der", "Berg", "Jr"]


def test_text_functions(spark):
    texts = ["Éclair-Crème 12", "ŁÓDŹ", "日本 go", None, "", "Straße", "éa"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalize(F.col("t")).alias("n"), tx.strip_html(F.col("t")).alias("h")).collect()
    assert [r.n for r in rows] == [tx.normalize_text(t) for t in texts]
    v = spark.createDataFrame([("1.10",), ("1.9",), ("1.9.1",)], "v string").orderBy(version_key(F.col("v"))).collect()
    assert [r.v for r in v] == ["1.9", "1.9.1", "1.10"]


def test_closure_has_no_bound_of_its_own():
    import inspect

    assert inspect.signature(hierarchy.closure).parameters["max_depth"].default is None
    assert inspect.signature(hierarchy.reachable).parameters["max_depth"].default is None


def test_code_systems_of_any_depth(spark):
    kind, tree = "struct<code:string,display:string>", {"code": "c14", "display": "d"}
    for k in range(13, -1, -1):
        kind, tree = f"struct<code:string,display:string,concept:array<{kind}>>", {"code": f"c{k}", "display": "d", "concept": [tree]}
    concepts, edges = terminology.flatten_concepts(spark.createDataFrame([("u", [tree])], f"url string, concept array<{kind}>"))
    assert {r.code for r in concepts.collect()} == {f"c{k}" for k in range(15)}
    assert {(r.child, r.parent) for r in edges.collect()} == {(f"c{k + 1}", f"c{k}") for k in range(14)}


def test_closure_with_cycle_and_diamond(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("d", "e"), ("e", "c"), (None, "x")], "child string, parent string")
    got = {(r.child, r.parent) for r in hierarchy.closure(edges).collect()}
    links = {("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("d", "e"), ("e", "c")}
    want = set(links)
    while more := {(x, w) for x, y in want for z, w in links if y == z} - want:
        want |= more
    assert got == want
    start = spark.createDataFrame([("d",)], "id string")
    assert {r.id: r.depth for r in hierarchy.reachable(edges, start, "child", "parent").collect()} == {"d": 0, "b": 1, "e": 1, "c": 2, "a": 3}


def test_history(spark):
    v = spark.createDataFrame([("T", "1", 1, "2020-01-01", "a", False), ("T", "1", 2, "2020-01-03", "b", False), ("T", "2", 1, "2020-01-02", "c", False), ("T", "2", 2, "2020-01-04", None, True)], "resource_type string, id string, version_id bigint, last_updated string, resource string, deleted boolean").withColumn("last_updated", F.col("last_updated").cast("timestamp"))
    assert {(r.id, r.resource) for r in history.current(v).collect()} == {("1", "b")}
    assert {(r.id, r.resource) for r in history.as_of(v, "2020-01-02").collect()} == {("1", "a"), ("2", "c")}
    assert {(r.id, r.version_id) for r in history.hard_delete(v, v.filter("id = '1' AND version_id = 2").select("resource_type", "id", "version_id")).filter("id = '1'").collect()} == {("1", 1)}
    assert [r.version_id for r in history.read(v, "T", "1", 1).collect()] == [1] and history.read(v, "T", "2").count() == 0
    entries = spark.createDataFrame([("b", 0, "GET"), ("b", 1, "PUT"), ("b", 2, "DELETE"), ("b", 3, "POST")], "bundle string, position int, method string")
    assert [r.method for r in history.order_entries(entries).orderBy("step").collect()] == ["DELETE", "POST", "PUT", "GET"]
    refs = spark.createDataFrame([("urn:uuid:1",), ("Patient/9",)], "reference string")
    names = spark.createDataFrame([("urn:uuid:1", "Patient/1")], "full_url string, assigned string")
    assert {r.reference for r in history.rewrite_references(refs, names).collect()} == {"Patient/1", "Patient/9"}
    assert history.patch({"a": [1, 2]}, [{"op": "add", "path": "/a/-", "value": 3}, {"op": "remove", "path": "/a/0"}, {"op": "move", "from": "/a", "path": "/b"}]) == {"b": [2, 3]}


def test_snapshot():
    base = [{"path": "P"}, {"path": "P.x", "min": 0, "max": "*", "binding": {"strength": "preferred"}}, {"path": "P.y", "min": 0, "max": "1"}]
    diff = [{"path": "P.x", "min": 1, "max": "2", "binding": {"strength": "required"}}, {"id": "P.x:s", "path": "P.x", "sliceName": "s", "min": 0}]
    full = snapshot(base, diff)
    assert [e.get("id", e["path"]) for e in full] == ["P", "P.x", "P.x:s", "P.y"] and full[1]["max"] == "2" and full[2]["min"] == 0
    assert {d["id"] for d in differential(base, full)} == {"P.x", "P.x:s"}
    with pytest.raises(ValueError):
        merge_element({"path": "x", "binding": {"strength": "required"}}, {"path": "x", "binding": {"strength": "example"}})
    assert [e["path"] for e in expand_choice({"path": "O.value[x]", "type": [{"code": "string"}, {"code": "Quantity"}]})] == ["O.valueString", "O.valueQuantity"]


def test_unknown_elements(spark):
    raw = spark.createDataFrame([("1", '{"resourceType":"P","id":"1","x":1,"_x":{},"bad":2}')], "id string, json string")
    assert [r.path for r in unknown_elements(raw, ["x"]).collect()] == ["bad"]


def test_formats(spark, tmp_path):
    import io
    import json
    import tarfile

    doc = {"resourceType": "Patient", "id": "p", "active": True, "name": [{"family": "D&o", "given": ["A", "B"]}], "birthDate": "1980-01-01", "_birthDate": {"extension": [{"url": "t", "valueInteger": 3}]}}
    assert json.loads(formats.xml_to_json(formats.json_to_xml(json.dumps(doc)))) == doc
    rows = formats.convert(formats.convert(spark.createDataFrame([(json.dumps(doc),), (None,)], "j string"), "j", "x", "xml"), "x", "back", "json").collect()
    assert json.loads(rows[0].back) == doc and rows[1].back is None
    with tarfile.open(tmp_path / "p.tgz", "w:gz") as tar:
        for name, body in (("package/package.json", {"name": "n", "version": "1.0"}), ("package/a.json", doc)):
            raw = json.dumps(body).encode()
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    got = formats.read_packages(spark, str(tmp_path / "p.tgz")).collect()
    assert [(r.package, r.version, r.resource_type, r.id) for r in got] == [("n", "1.0", "Patient", "p")]
    v = spark.createDataFrame([("u", "1.2.0", "a"), ("u", "1.10.0", "b"), ("u", "1.10.0-rc", "c")], "url string, version string, json string")
    assert formats.latest_versions(v).first().json == "b"
    refs = formats.resolve_canonical(v, spark.createDataFrame([("u",), ("u|1.2.0",), ("w",)], "canonical string"))
    assert {(r.canonical, r.resolved) for r in refs.collect()} == {("u", "b"), ("u|1.2.0", "a"), ("w", None)}
    spark.createDataFrame([(json.dumps(doc),)], "value string").write.text(str(tmp_path / "nd"))
    read = formats.as_variant(formats.read_json_lines(spark, str(tmp_path / "nd"))).select("id", F.expr("variant_get(variant, '$.name[0].family', 'string')").alias("f")).first()
    assert (read.id, read.f) == ("p", "D&o")


def test_stream_is_idempotent(spark, sf, tmp_path):
    from sparkclin.streaming.index_stream import activity, maintain, read_index, read_stream, read_versions

    source, out = Store.from_tables(spark, sf, "Location").resources("Location"), str(tmp_path / "out")
    for k in (1, 2, 3):  # the same versions arrive again, at last to a query without a checkpoint
        source.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        maintain(read_stream(spark, str(tmp_path / "in"), source.schema), out, str(tmp_path / f"cp{k // 3}")).awaitTermination()
    assert read_versions(spark, out).count() == source.count() == 30
    assert read_index(spark, out, "reference").count() == 25
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(f"{sf}/events.parque[t]")
    q = activity(events).writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM activity").first().n == 1000


def test_stream_survives_a_failure_between_writes(spark, sf, tmp_path, monkeypatch):
    from sparkclin.streaming import index_stream

    rows, out = Store.from_tables(spark, sf, "Location").resources("Location"), str(tmp_path / "out")

    def fail(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:  # everything is written but the commit
        m.setattr(index_stream, "_commit", fail)
        with pytest.raises(RuntimeError):
            index_stream.write_batch(rows, out, "q-0", Catalog.default())
    assert index_stream.read_versions(spark, out) is None and index_stream.read_index(spark, out, "reference") is None
    for _ in range(2):  # run again, and once more after the commit
        index_stream.write_batch(rows, out, "q-0", Catalog.default())
    index_stream.write_batch(rows.limit(3), out, "q-1", Catalog.default())
    assert index_stream.read_versions(spark, out).count() == 30 and index_stream.read_index(spark, out, "reference").count() == 25


def test_stream_deals_rows_out_before_it_sorts(spark, sf, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from sparkclin.streaming import index_stream

    Store.from_tables(spark, sf, "Location").resources("Location").repartition(2).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(index_stream, "ROWS", 5, raising=False)
    kept, persist = [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: (kept.append((plan_of(self), self.rdd.getNumPartitions())), persist(self, *a))[1])
    out = str(tmp_path / "out")
    index_stream.write_batch(rows.unionByName(rows), out, "q-0", Catalog.default())
    plan, n = kept[0]
    below = plan[plan.rindex("Exchange hashpartitioning") :]  # what a task does with the rows it reads
    assert "Sort" not in below and "Aggregate" not in below and n == 12  # 60 rows
    assert index_stream.read_versions(spark, out).count() == 30


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_conditions_on_own_values_are_filters(spark, sf):
    s = Search(Store.from_tables(spark, sf))
    for url in ("Encounter?status=F,P", "Encounter?date=ge1997-03&date=lt1997-05-10", "Encounter?_lastUpdated=ge2000-01-01", "Observation?component-code-value=urn:component|price$gt90000", "Patient?balance=gt5", "Location?partof:missing=true",
                "Encounter?_filter=(status eq F and total gt 200000) or not (priority eq 5-LOW)", "Patient?name:contains=a&_id=1"):
        plan = plan_of(s.matches(url))
        assert "Exchange" not in plan and "Join" not in plan, url
    assert plan_of(s.matches("Observation?encounter.subject.segment=FURNITURE&value-quantity=lt3")).count("lineitem.parquet") == 1


def test_search_values(spark):
    from sparkclin.plans.catalog import SearchParam

    kind = "a array<struct<code:struct<coding:array<struct<system:string,code:string>>>,q:struct<value:double,system:string,code:string>,r:struct<reference:string>,u:string,s:string>>, r array<struct<reference:string,display:string>>, s array<string>"
    rows = [
        ("1", '{"r":[{"reference":"#a"}],"s":["Ώμέγα"],"a":[{"code":{"coding":[{"system":"S","code":"k"}]},"q":{"value":5,"system":"http://unitsofmeasure.org","code":"mg"},"r":{"reference":"Tx/1"},"u":"http://x/y","s":"Éa"}]}'),
        ("2", '{"r":[{"reference":"#b","display":"Doctor Who"}],"s":["ﬁsh"],"a":[{"code":{"coding":[{"code":"k"}]},"q":{"value":5,"system":"http://unitsofmeasure.org","code":"g"},"r":{"reference":"Ux/1"},"u":"http://x/z","s":"b"}]}'),
        ("3", '{"r":[{"reference":"http://c|1.10"},{"reference":"a"}],"s":["cat"],"a":null}'),
        ("4", '{"r":[{"reference":"http://c|1.9"}],"s":["dog"]}'),
    ]
    df = spark.createDataFrame(rows, "id string, j string").select(F.lit("P").alias("resource_type"), "id", F.lit(1).cast("long").alias("version_id"), F.lit("2020-01-01").cast("timestamp").alias("last_updated"), F.from_json("j", kind).alias("resource"))
    c = Catalog({})
    for p in (SearchParam("r", "P", "reference", "r"), SearchParam("s", "P", "string", "s"), SearchParam("cq", "P", "composite", "a", (), (("c", "code", "token"), ("q", "q", "quantity"))), SearchParam("cr", "P", "composite", "a", (), (("c", "code", "token"), ("r", "r", "reference"))), SearchParam("su", "P", "composite", "a", (), (("s", "s", "string"), ("u", "u", "uri")))):
        c.add(p)
    s = Search(Store({"P": df}, c))
    want = {
        "r=%23a": "1", "r=a": "3", "r:text=doctor": "2", "r:text-advanced=who": "2", "r:code-text=B": "2", "r:above=http://c|1.10": "3", "r:below=http://c|1.9": "4", "r=http://c|1": "34", "s=ΩΜΕΓΑ": "1", "s:contains=FI": "2", "s=fish": "2",
        "cq=S|k$5": "1", "cq=|k$5": "2", "cq=K$5": "12", "cq=k$5|http://unitsofmeasure.org|mg": "1", "cq=k$5||g": "2", "cr=k$Tx/1": "1", "cr=k$1": "12", "su=EA$http://x/y": "1", "su=e$http://x": "",
        "_filter=s eq fish or s ew g": "24", "_filter=not (s co at) and r pr true": "124",
    }
    for url, ids in want.items():
        assert "".join(sorted(r.id for r in s.matches(f"P?{url}").collect())) == ids, url
    for bad in ("name gt ca", "s gt ca", "s re ca", "r co x", "s in v", "_id gt 3"):
        with pytest.raises(SearchError):
            s.matches(f"P?_filter={bad}")
    with pytest.raises(SearchError):
        s.matches("P?r:exact=x")


def test_composites_of_many_tuples(spark):
    from sparkclin.plans.catalog import SearchParam

    df = spark.range(1).select(F.lit("P").alias("resource_type"), F.lit("1").alias("id"), F.lit(1).cast("long").alias("version_id"), F.struct(F.array(F.struct(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda x: x.cast("double")).alias("x"), F.transform(F.sequence(F.lit(1), F.lit(50)), lambda x: x.cast("double")).alias("y"))).alias("g")).alias("resource"))
    assert indexing.shred(df, [SearchParam("c", "P", "composite", "g", (), (("x", "x", "number"), ("y", "y", "number")))]).count() == 3000


def test_content_of_all_text(spark):
    kind = "text struct<status:string,div:string>, code struct<text:string,coding:array<struct<system:string,code:string,display:string>>>, name array<struct<family:string,given:array<string>>>, telecom array<struct<system:string,value:string>>, note array<struct<text:string>>, description string"
    j = '{"text":{"status":"x","div":"<p>Told</p>"},"code":{"text":"Pain","coding":[{"system":"u","code":"c9","display":"Ache"}]},"name":[{"family":"Doe","given":["Al",null]}],"telecom":[{"system":"phone","value":"555"}],"note":[{"text":"see"},{"text":"see"}],"description":"own"}'
    df = spark.createDataFrame([("1", j), ("2", "{}")], "id string, j string").select(F.lit("P").alias("resource_type"), "id", F.lit(1).cast("long").alias("version_id"), F.from_json("j", kind).alias("resource"))
    got = {r.id: r.content for r in indexing.content_text(df).collect()}
    assert got == {"1": "Told Pain Ache Doe Al 555 see own", "2": ""}
    assert [r.content for r in indexing.narrative_text(df).collect()] == ["Told"]


def test_catalog():
    c = Catalog.default()
    v = c.version()
    from sparkclin.plans.catalog import SearchParam

    c.add(SearchParam("x", "Resource", "token", "id"))
    assert c.version() != v and c.find("Patient", "x") is not None


def test_age_and_reference_identifier(spark):
    from sparkclin.plans.catalog import SearchParam

    df = spark.createDataFrame([("1", "1980-06-15"), ("2", "1980-06-16"), ("3", "1979-06-15"), ("4", "2000")], "id string, birthDate string")
    who = F.struct(F.struct(F.lit("urn:o").alias("system"), F.concat(F.lit("O"), F.col("id")).alias("value")).alias("identifier"), F.lit(None).cast("string").alias("reference"))
    df = df.select(F.lit("Patient").alias("resource_type"), "id", F.lit(1).cast("long").alias("version_id"), F.lit("2020-01-01").cast("timestamp").alias("last_updated"), F.struct(F.lit("Patient").alias("resourceType"), "id", "birthDate", who.alias("org")).alias("resource"))
    c = Catalog.default()
    c.add(SearchParam("birthdate", "Patient", "date", "birthDate"))
    c.add(SearchParam("org", "Patient", "reference", "org", ("Organization",)))
    s = Search(Store({"Patient": df}, c), today="2020-06-15")
    ids = lambda url: {r.id for r in s.matches(url).collect()}
    assert ids("Patient?age=40") == {"1"} and ids("Patient?age=ge40") == {"1", "3"} and ids("Patient?age=lt40") == {"2", "4"}
    assert ids("Patient?org:identifier=urn:o|O2") == {"2"}


def test_command_line_and_sql(spark, tmp_path, capsys):
    from sparkclin.__main__ import main
    from sparkclin.fhirpath.interpreter import evaluate_xml, register_sql

    (tmp_path / "p.json").write_text('{"resourceType":"Patient","name":[{"family":"Doe"}]}')
    main(["fp", "name.family", str(tmp_path / "p.json")])
    main(["xml", str(tmp_path / "p.json")])
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "Doe" and evaluate_xml("Patient.name.family", out[1]) == ["Doe"]
    main(["tree", "a.where(b)"])
    assert "call 'where'" in capsys.readouterr().out
    register_sql(spark)
    assert spark.sql("""SELECT fhirpath('{"a":[1,2]}', 'a.first() + 1') AS v""").first().v == ["2"]
