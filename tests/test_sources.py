import json

import pytest
from pyspark.sql import functions as F

from quakelake.operators import index as I
from quakelake.session import cut_lineage
from quakelake.sources import catalogs as C
from quakelake.sources import files, sinks
from quakelake.sources import picks as P
from quakelake.sources import tables as T
from quakelake.streaming import jobs

GOOD = "Pg,32640.180,0.937,2021-05-21 09:04:00.185000,23.796,892.73,YN.YSW03.00,N,0.000"
LINES = [
    "#first.mseed",
    GOOD,
    "Sg,1.0,0.5,2021-05-21 09:05:00.1,3.0,x,YN.A",
    "Pg,1,0.5,2021-05-21 09:05:00.100000,bad,1,YN.B,U,0.1",
    "Pg,1,0.5,2021-05-21 09:05:00.100000,2.0,1",
    "",
    "#second.mseed",
    "Pn,2.5,0.7,2021-05-21 10:00:00.000001,4.0,10.0,YN.C,D",
    "P,2.5,0.7,2021-05-21 10:00:00",
]


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.fixture
def pick_dir(tmp_path):
    put(tmp_path / "a" / "my_picks_1.txt", "\n".join(LINES) + "\n")
    put(tmp_path / "notes.txt", "not picks")
    return str(tmp_path)


def test_pick_rows(spark, pick_dir):
    got = P.read_picks(spark, pick_dir).orderBy("time").collect()
    assert [(r["phase"], r["station"], r["snr"]) for r in got] == [("Pg", "YN.YSW03.00", 23.796), ("Sg", "YN.A", 3.0), ("Pn", "YN.C", 4.0)]
    full = P.read_full_picks(spark, pick_dir + "/a").orderBy("abs_time").collect()
    assert [(r["phase"], r["polarity"], r["source"]) for r in full] == [("Pg", "N", "first.mseed"), ("Pn", "D", "second.mseed")]
    lenient = P.read_lenient_picks(spark, pick_dir + "/a").collect()
    assert sorted((r["phase"], r["snr"], r["station"], r["polarity"]) for r in lenient) == sorted(
        [("Pg", 23.796, "YN.YSW03.00", "N"), ("Sg", 3.0, "YN.A", "N"), ("Pg", 2.0, "", "N"), ("Pn", 4.0, "YN.C", "D"), ("P", 0.0, "", "N")]
    )


def test_no_picks_is_an_error(spark, tmp_path):
    put(tmp_path / "x.txt", "nothing")
    with pytest.raises(ValueError):
        P.read_picks(spark, str(tmp_path))


def test_headers_carry_over_splits(spark, tmp_path):
    """A file cut into many splits gives the same carried headers."""
    rows = [f"#w{i}.mseed" if i % 40 == 0 else GOOD.replace("0.937", f"0.{i:05d}") for i in range(1000)]
    path = put(tmp_path / "big.txt", "\n".join(rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        lines = P.read_lines(spark, path)
        assert lines.select("block").distinct().count() > 5
        got = {r["confidence"]: r["source"] for r in P.parse_full_picks(P.with_waveform_file(lines)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {float(f"0.{i:05d}"): f"w{i // 40 * 40}.mseed" for i in range(1000) if i % 40}


def test_csv_catalog(spark, tmp_path):
    path = put(tmp_path / "c.csv", "# comment\nMAG,ml,Lon,Lat,Time\n3.2,9,104.1,29.5,2021-05-21T09:04:00\nbad,9,104.2,29.6,2019-01-15\n4.1,9,x\n")
    got = C.read_catalog(spark, path).collect()
    assert [(r["magnitude"], r["longitude"], r["latitude"], r["time"] is None) for r in got] == [(3.2, 104.1, 29.5, False), (None, 104.2, 29.6, True), (4.1, None, None, True)]
    assert C.read_csv(spark, path, date_only=True).filter("time IS NULL").count() == 1
    with pytest.raises(ValueError):
        C.read_csv(spark, put(tmp_path / "d.csv", "a,b\n1,2\n"))


@pytest.mark.parametrize("wrap", [None, "events", "data", "catalog", "earthquakes"])
def test_json_catalog(spark, tmp_path, wrap):
    records = [{"Mag": 3.5, "LAT": "30.1", "origin_time": "2021-05-21 09:04:00.5"}, {"magnitude": "bad", "x": 1}, {"ML": 2, "mag": 7}]
    path = put(tmp_path / "c.json", json.dumps(records if wrap is None else {"meta": 1, wrap: records}, indent=1))
    got = C.read_catalog(spark, path).collect()
    assert [(r["magnitude"], r["latitude"], r["longitude"]) for r in got] == [(3.5, 30.1, None), (None, None, 1.0), (7.0, None, None)]
    assert got[0]["time"].microsecond == 500000


def test_txt_dispatch(spark, tmp_path):
    picks = put(tmp_path / "p.txt", "\n".join(LINES))
    table = put(tmp_path / "t.txt", "time,mag\n2021-05-21 09:04:00,3\n")
    assert "phase" in C.read_catalog(spark, picks).columns
    assert C.read_catalog(spark, table).head()["magnitude"] == 3.0
    with pytest.raises(ValueError):
        C.read_catalog(spark, "x.xls")


def test_delimited_and_small_tables(spark, tmp_path):
    got = C.read_delimited(spark, put(tmp_path / "w.dat", "# c\nlon lat mag\n1 2  3\n4 5 6\n")).orderBy("lon").collect()
    assert [tuple(r) for r in got] == [("1", "2", "3"), ("4", "5", "6")]
    model = T.read_velocity_model(spark, put(tmp_path / "v.csv", "# model\ndepth_km,vp,vs,density\n0,4.5,2.6,2.4\n10,6.0,3.5\n")).collect()
    assert [tuple(r) for r in model] == [(0.0, 4.5, 2.6, 2.4), (10.0, 6.0, 3.5, None)]
    stations = T.read_stations(spark, put(tmp_path / "s.txt", "YN A 00 100.5 25.5 1200\nYN,B,00,101,26\nbad\n")).orderBy("code").collect()
    assert [(r["station"], r["longitude"], r["elevation"]) for r in stations] == [("YN.A", 100.5, 1200.0), ("YN.B", 101.0, 0.0)]
    mech = T.read_mechanisms(spark, put(tmp_path / "m.csv", "strike,dip,rake,name\n10,20,30,a\n")).head()
    assert tuple(mech) == (10.0, 20.0, 30.0, "a")
    faults = T.read_faults(spark, put(tmp_path / "f.txt", "> one\n1 1\n2 2\n3 2\n\n5 5\n6 6\n>\n9 9\n"))
    assert sorted((r["lon1"], r["lon2"]) for r in faults.collect()) == [(1.0, 2.0), (2.0, 3.0), (5.0, 6.0)]


def test_file_listing(spark, tmp_path):
    put(tmp_path / "d" / "a.txt", "one\ntwo\n")
    put(tmp_path / "d" / "b.exe", "x")
    put(tmp_path / "d" / "e" / "c.MD", "# t\nbody")
    got = files.listing(spark, str(tmp_path / "d"), [".txt", ".md"]).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got) == ["a.txt", "c.MD"]
    assert {r["path"].rsplit("/", 1)[1]: r["n_lines"] for r in files.line_counts(spark, str(tmp_path / "d")).collect()}["a.txt"] == 2
    texts = T.read_texts(spark, str(tmp_path / "d"), "*.txt").head()
    assert texts["text"] == "one\ntwo\n"


def test_fingerprint_covers_all_bytes(spark):
    import hashlib

    data = [bytes([i % 251]) * n for i, n in enumerate((10, 16384, 20000))]
    rows = spark.createDataFrame([(bytearray(x),) for x in data], "b binary").select("b", I.fingerprint(F.col("b")).alias("h")).collect()
    assert all(r["h"] == hashlib.sha256(bytes(r["b"])).hexdigest() for r in rows)
    doc = spark.range(1).select(I.document_id(F.lit("p"), F.lit("n.md"), F.lit("body").cast("binary")).alias("d")).head()["d"]
    assert doc == hashlib.md5(b"p/n.md|body").hexdigest()[:12]


def test_stores_keep_old_versions_until_complete(spark, tmp_path):
    store = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        sinks.load_store(spark, store)
    assert sinks.save_store(spark.range(3), store) == 1
    assert sinks.save_store(sinks.load_store(spark, store).union(spark.range(2)), store) == 2
    (tmp_path / "store" / "v=3").mkdir()
    assert sinks.load_store(spark, store).count() == 5 and sinks.load_store(spark, store, 1).count() == 3


def test_polarity_and_evidence_sinks(spark, tmp_path):
    df = spark.createDataFrame([("YN.A", "2024-01-01 00:00:00", "U", 0.91234)], "station string, s string, polarity string, prob double").withColumn("abs_time", F.to_timestamp("s"))
    sinks.write_polarity(df, str(tmp_path / "pol"))
    body = "".join(f.read_text() for f in (tmp_path / "pol").glob("part*"))
    # Every part file, an empty one too, opens with the header.
    assert set(body.splitlines()) == {"# Station,Time,Polarity,Confidence", "YN.A,2024-01-01 00:00:00.000000,U,0.912"}
    sinks.write_json(df.drop("abs_time"), str(tmp_path / "ev"))
    assert spark.read.json(str(tmp_path / "ev")).head()["station"] == "YN.A"
    assert sinks.polarity_input_lines(df).head()["value"].split() == ["YN.A", "U"]


def test_front_matter(spark):
    text = '---\nname: "b value"\ndescription:  two\nkeywords: a, b , c\nrelated_skills:\n  - x\n  - "y z"\n---\n\nBody\n---\nmore'
    df = spark.createDataFrame([(text,), ("no block",)], "text string")
    rows = T.front_matter(df).orderBy(F.desc("name")).collect()
    assert (rows[0]["name"], rows[0]["keywords"], rows[0]["related_skills"], rows[0]["rag_sources"]) == ("b value", ["a", "b", "c"], ["x", "y z"], [])
    assert rows[0]["body"] == "Body\n---\nmore" and rows[1]["body"] == "no block" and rows[1]["name"] is None


# --- streams and restarts -----------------------------------------------------------------------


def test_index_skips_known_documents_and_records_failures(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, f"Document number {i} has a sentence that is long enough.") for i in range(4)] + [(9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(src)
    store, folder = str(tmp_path / "store"), str(tmp_path / "run")
    stream = jobs.table_stream(spark, src, "*.parquet")
    manifest, chunks = jobs.index_documents(stream, store, folder)
    assert chunks.count() == 4
    assert {r["doc_id"]: r["status"] for r in manifest.collect()} == {0: "indexed", 1: "indexed", 2: "indexed", 3: "indexed", 9: "failed"}
    more = rows[:2] + [(20, "A later document with a sentence of its own, long enough.")]
    spark.createDataFrame(more, "doc_id long, text string").write.mode("append").parquet(src)
    manifest, chunks = jobs.index_documents(jobs.table_stream(spark, src, "*.parquet"), store, folder)
    assert sorted(r["doc_id"] for r in chunks.collect()) == [0, 1, 2, 3, 20]


def test_index_versions_over_two_progress_folders(spark, tmp_path):
    store = str(tmp_path / "store")

    def arrive(name, rows):
        src = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(src)
        manifest, chunks = jobs.index_documents(jobs.table_stream(spark, src, "*.parquet"), store, f"{src}-run")
        state = {r["doc_id"]: (r["status"], r["version"]) for r in manifest.collect()}
        return state, {r["doc_id"]: r["text"] for r in chunks.collect()}

    assert arrive("a", [(1, "alpha"), (2, "beta"), (5, None)]) == ({1: ("indexed", 1), 2: ("indexed", 1)}, {1: "alpha", 2: "beta"})
    state, texts = arrive("b", [(1, "alpha"), (2, "changed"), (3, "gamma")])
    assert texts == {1: "alpha", 2: "changed", 3: "gamma"} and state[1] == ("indexed", 1) and state[2] == ("indexed", 2)
    state, texts = arrive("c", [(1, None), (2, "beta")])
    assert texts == {2: "beta", 3: "gamma"} and state[1] == ("deleted", 2) and state[2] == ("indexed", 3)


def test_open_windows_come_out_at_the_end(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(f"2024-01-0{d} 10:00:00", "x") for d in (1, 1, 2)]
    spark.createDataFrame(rows, "t string, k string").select(F.col("t").cast("timestamp").alias("time"), "k").write.parquet(src)
    got = jobs.run_to_end(jobs.table_stream(spark, src, "*.parquet"), "time", lambda s: jobs.rolling_rate(s, keys=["k"]), str(tmp_path / "run"))
    assert sorted((r["k"], r["n"]) for r in got.collect()) == [("x", 1), ("x", 2)]


def test_evidence_merges_over_restarts(spark, tmp_path):
    src, store, folder = (str(tmp_path / n) for n in ("in", "store", "run"))
    schema = "seq long, observation string"
    spark.createDataFrame([(1, "a" * 90), (2, "b"), (3, "a" * 80 + "x")], schema).write.parquet(src)
    first = jobs.merge_evidence(jobs.table_stream(spark, src, "*.parquet"), store, folder)
    assert sorted(r["seq"] for r in first.collect()) == [1, 2, 3]
    spark.createDataFrame([(4, "b"), (5, "c")], schema).write.mode("append").parquet(src)
    both = jobs.merge_evidence(jobs.table_stream(spark, src, "*.parquet"), store, folder)
    assert sorted(r["seq"] for r in both.collect()) == [1, 2, 3, 5]
    again = jobs.merge_evidence(jobs.table_stream(spark, src, "*.parquet"), store, str(tmp_path / "other"))
    assert sorted(r["seq"] for r in again.collect()) == [1, 2, 3, 5]


def test_lineage_is_cut_in_the_shared_folder(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    cut = cut_lineage(df, str(tmp_path / "ck"))
    assert sorted(cut.collect()) == sorted(df.collect())


def test_file_priority(spark):
    paths = ["p/README.md", "p/a/b.md", "p/c.txt", "p/d.pdf", "p/e.html", "p/f.docx", "p/.hidden.md", "p/x.exe", "root.md"]
    df = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    kept = [r["rel_path"] for r in I.key_files(df, max_files=3).collect()]
    assert sorted(kept) == ["p/README.md", "p/a/b.md", "p/c.txt", "root.md"]


def test_differential_time_lines_in_order_by_one_shuffle(spark):
    rows = [(2, 3, "B", "P"), (1, 2, "B", "S"), (1, 2, "A", "S"), (1, 2, "A", "P"), (1, 9, "C", "P")]
    pairs = spark.createDataFrame([(*r, 1.0, 2.5, 0.5) for r in rows], "ev1 long, ev2 long, station string, phase string, tp1 double, tp2 double, weight double")
    lines = sinks.differential_time_lines(pairs.repartition(3))
    body = lambda s, p: f"{s:<8} {1.0:9.3f} {2.5:9.3f} {0.5:7.4f} {p}"
    assert [r["value"] for r in lines.collect()] == [
        "# 1 2 0.0", body("A", "P"), body("A", "S"), body("B", "S"), "# 1 9 0.0", body("C", "P"), "# 2 3 0.0", body("B", "P"),
    ]
    plan = sinks.differential_time_lines(pairs)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan
