import pytest
from pyspark.sql import functions as F

from reelspark.functions import enrich, fmt, text, title


def one(spark, make, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*(F.col(c) for c in df.columns)).alias("x")).first().x


@pytest.mark.parametrize(("n", "want"), [(None, "—"), (0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (2304, "2.2 KB"), (524288000, "500.0 MB"), (1073741824, "1.0 GB"), (4800000000, "4.5 GB")])
def test_bytes(spark, n, want):
    assert spark.createDataFrame([(n,)], "n long").select(fmt.bytes_text(F.col("n")).alias("x")).first().x == want


def test_sizes_keep_to_the_units_of_their_sql(spark, tmp_path):
    """Empty texts, none, and texts of millions of characters, by the registered queries and by their SQL."""
    import duckdb

    import __spark_entry__ as e

    sizes = [None, 0, 0, 1, 4095, 4096, 4097, 65536, 4194303, 4194304, 10737418, 10737419, 1 << 28, 1666630796019499, 2138142714137936]
    rows = [(i + 1, "text", "en", f"src{i % 3}", n) for i, n in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, 3, "click", 0.5)], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as con:
        for t in ("documents", "labels", "events"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        for name in ("fmt_bytes", "page_texts"):
            want = con.execute(e.oracle_sql()[name]).fetchall()
            assert sorted(map(repr, map(tuple, e.queries()[name](spark, str(tmp_path)).collect()))) == sorted(map(repr, want)), name


@pytest.mark.parametrize(("n", "want"), [(None, "—"), (0.0, "0:00"), (59.9, "0:59"), (1800.0, "30:00"), (3600.0, "1:00:00"), (7200.0, "2:00:00")])
def test_durations(spark, n, want):
    assert spark.createDataFrame([(n,)], "n double").select(fmt.duration_text(F.col("n")).alias("x")).first().x == want


def test_keys_and_lists(spark):
    assert one(spark, text.split_terms, " Foi; foi | Grâce,\n ;PRIÈRE ") == ["Foi", "Grâce", "PRIÈRE"]
    assert one(spark, text.label_key, "  Été   Prioritaire ") == "ete prioritaire"
    assert one(spark, text.label_key, "Groß") == "gross" and one(spark, text.label_key, " A  b ") == "a b"
    assert one(spark, text.term_key, "  La   Foi ") == "la foi"
    assert one(spark, lambda c: text.like(c, "%É_a\\%"), "xÉbA\\y") and not one(spark, lambda c: text.like(c, "%é%"), "É")


@pytest.mark.parametrize(("link", "want"), [("abc", "abc"), ("https://drive.google.com/drive/folders/XYZ?usp=s", "XYZ"), ("https://drive.google.com/drive/u/0/folders/XYZ/", "XYZ"), ("https://drive.google.com/open?id=XYZ&a=1", "XYZ"), ("https://example.com/x", None)])
def test_folder_ids(spark, link, want):
    assert one(spark, text.folder_id, link) == want


@pytest.mark.parametrize(
    ("name", "folder", "year", "speaker", "clean", "normal", "keywords"),
    [
        ("Intro to Python.mp4", "/Courses/Python", "", "Intro Python", "Intro to Python", "intro to python", ["courses", "intro", "python"]),
        ("Team Standup Recording.webm", "/Meetings/2025", "", "Team Standup", "Recording", "team standup recording", ["2025", "meetings", "recording", "standup", "team"]),
        ("2021_JohnPiper_Faith-final.mp4", "", "", "JohnPiper Faith", "2021", "2021 johnpiper faith", ["2021", "faith", "johnpiper"]),
        ("2021-hope.mp4", "", "2021", "", "Hope", "2021 hope", ["2021", "hope"]),
        ("K7-001-convention-yaounde-brut.mp4", "/Dpt DIGITAL/Demo/Videos brutes", "", "", "K7 001 Convention Yaounde Brut", "k7 001 convention yaounde brut", ["brut", "brutes", "convention", "demo", "digital", "yaounde"]),
    ],
)
def test_titles(spark, name, folder, year, speaker, clean, normal, keywords):
    df = spark.createDataFrame([(name, folder)], "n string, f string").withColumn("w", title.tokens(F.col("n"))).withColumn("s", title.speaker(F.col("w")))
    row = df.select(
        title.year(F.col("n")).alias("y"), "s", title.clean_title(F.col("n"), F.col("w"), title.year(F.col("n")), F.col("s")).alias("c"),
        title.normalized_name(F.col("w")).alias("m"), title.keywords(F.col("w"), F.col("f")).alias("k"),
    ).first()
    assert tuple(row) == (year, speaker, clean, normal, keywords)


def test_rules(spark):
    refs = lambda a, b: one(spark, lambda x, y: enrich.references(F.concat_ws(" ", x, y)), a, b)
    assert refs("Sermon on John 3:16 and 1 John 4:8-10.mp4", "/Bible Study") == ["John 3:16", "1 John 4:8-10"]
    assert refs("Psalm_23.mp4", "") == refs("2021_John 3.mp4", "") == []
    low = lambda f, t: one(spark, lambda c: f(F.lower(c)), t)
    assert low(enrich.main_theme, "Power of prayer and faith.mp4") == "Prayer" and low(enrich.main_theme, "Entrusted.mp4") == "Faith"
    assert low(enrich.teaching_type, "Department update.mp4") == "Teaching Series"
    assert len(set(enrich.BOOKS)) == 67


def test_probe(spark):
    doc = '{"streams":[{"codec_type":"video","width":%d,"height":%d,"avg_frame_rate":"%s","r_frame_rate":"25/1"}],"format":{}}'
    got = {}
    for w, h, rate in ((1920, 1080, "30000/1001"), (1080, 1920, "0/0"), (720, 576, ""), (500, 500, "x/y")):
        m = fmt.parsed(spark.createDataFrame([(doc % (w, h, rate),)], "probe string"), F.col("probe")).first().media
        got[w, h] = (m.aspect_ratio, m.orientation, m.fps, m.has_audio)
    assert got == {(1920, 1080): ("16:9", "landscape", 29.97, False), (1080, 1920): ("9:16", "portrait", None, False), (720, 576): ("5:4", "landscape", 25.0, False), (500, 500): ("1:1", "landscape", None, False)}


def test_dear_rows_are_dealt_to_all_cores(spark):
    from reelspark.plans import QUERIES

    for name in ("clean_title", "enriched_rows", "bible_refs", "topics"):  # one small file of names
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name
