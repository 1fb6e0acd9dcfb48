import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.operators import report as rp
from ticketlens.plans.catalog import QUERIES, Source
from ticketlens.plans.weekly import WeeklyConfig, run_weekly
from ticketlens.sources import readers, writers
from ticketlens.streaming import scoring

RECORDS = [
    {"ticket_id": "1", "text": 'line one\nline "two", three', "created_at": "2024-01-01T10:00:00"},
    {"ticket_id": "2", "text": "plain", "created_at": "2024-01-02T10:00:00"},
    {"ticket_id": "2", "text": " plain", "created_at": "2024-01-02T10:00:00"},
    {"ticket_id": "3", "text": "   ", "created_at": None},
]
FOLDER = "/root/testdata/sf0.001"


def write(path, kind):
    if kind == "csv":
        lines = ["ticket_id,text,created_at"]
        for r in RECORDS:
            quoted = r["text"].replace('"', '""')
            lines.append(f'{r["ticket_id"]},"{quoted}",{r["created_at"] or ""}')
        path.write_text("\n".join(lines) + "\n")
    elif kind == "json":
        path.write_text(json.dumps(RECORDS, indent=1))
    else:
        path.write_text("\n".join(json.dumps(r) for r in RECORDS))


@pytest.mark.parametrize("kind", ["csv", "json", "jsonl"])
def test_load(spark, tmp_path, kind):
    path = tmp_path / f"tickets.{kind.upper() if kind == 'json' else kind}"
    write(path, kind)
    assert readers.scan_tickets(spark, str(path)).count() == 4
    rows = readers.load_tickets(spark, str(path)).select("ticket_id", "text").collect()
    assert sorted(map(tuple, rows)) == [("1", 'line one\nline "two", three'), ("2", "plain")]


def test_quoted_line_breaks_survive_every_csv_path(spark, tmp_path):
    path = tmp_path / "tickets.csv"
    write(path, "csv")
    result = run_weekly(spark, str(path), str(tmp_path / "run"), WeeklyConfig(topic_counts=(2,)))
    tickets = spark.read.parquet(str(tmp_path / "run" / "stages" / "tickets"))
    assert result.n_tickets == 4 and tickets.filter("ticket_id = '1'").first()["text"] == RECORDS[0]["text"]
    assert readers.scan_csv(spark, str(path)).count() == 4
    assert readers.scan_tickets(spark, str(path), multi_line=False).count() == 5


@pytest.fixture
def cuts(spark):
    """Sets the size of the blocks that files are read in."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield cut
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def tricky_csv(rnd, end):
    cells = ["", "plain", "a b", "é日", '""', '"x, y"', '"line\nbreak"', '"she said ""hi"""', '"\n\n"', '",\n"', "5'", '"""\n"""', "12"]
    rows = ["a,b,c"] + [",".join(rnd.choice(cells) for _ in range(3)) for _ in range(rnd.randint(1, 14))]
    return end.join(rows) + rnd.choice(["", end, end + end])


def test_split_csv_equals_one_piece_at_every_cut(spark, tmp_path, cuts):
    rnd = random.Random(5)
    for k, size in enumerate([9, 24, 61]):
        folder = tmp_path / str(k)
        folder.mkdir()
        for i in range(3):
            (folder / f"{i}.csv").write_text(tricky_csv(rnd, "\n" if k % 2 else "\r\n"), newline="")
        cuts(size)
        got = sorted(map(repr, readers.scan_csv(spark, str(folder)).collect()))
        cuts(1 << 27)
        assert got == sorted(map(repr, readers.scan_csv(spark, str(folder), split=False).collect())), (k, size)


def test_split_csv_uses_many_tasks_and_states_headers(spark, tmp_path, cuts):
    path = tmp_path / "t.csv"
    path.write_text("id,text\n" + "".join(f'{i},"ticket {i},\n""quoted"" to its end"\n' for i in range(20_000)))
    cuts(100_000)
    df = readers.scan_csv(spark, str(path), T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())]))
    assert df.count() == 20_000 and df.agg(F.sum("id")).first()[0] == 19_999 * 10_000
    assert df.filter("text <> concat('ticket ', id, ',\n\"quoted\" to its end')").count() == 0
    from ticketlens.sources.splitting import CsvMachine, _pieces

    assert _pieces(spark, str(path), CsvMachine()).rdd.getNumPartitions() >= 8
    with pytest.raises(ValueError, match="does not name"):
        readers.scan_csv(spark, str(path), T.StructType([T.StructField("other", T.StringType()), T.StructField("text", T.StringType())]))
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "two" / "b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.scan_csv(spark, str(tmp_path / "two"))
    (tmp_path / "none.csv").write_text("")
    assert readers.scan_csv(spark, str(tmp_path / "none.csv")).collect() == []


def test_split_json_equals_one_piece_at_every_cut(spark, tmp_path, cuts):
    rnd = random.Random(6)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("more", T.MapType(T.StringType(), T.StringType()))])
    texts = ["", "plain", "} {", "a \\ b", 'q"q', "[{]}", "é日\n\t", "\\\"}", "}\\\\", "{" * 5]
    for k, size in enumerate([8, 33]):
        folder = tmp_path / str(k)
        folder.mkdir()
        for i in range(3):
            rows = [{"id": str(n), "text": rnd.choice(texts), "more": {rnd.choice(texts): rnd.choice(texts)}} for n in range(rnd.randint(0, 12))]
            (folder / f"{i}.json").write_text(json.dumps(rows, indent=rnd.choice([None, 1]), ensure_ascii=rnd.random() < 0.5))
        (folder / "one.json").write_text(json.dumps({"id": "alone", "text": "} {", "more": {"a": "b"}}))
        cuts(size)
        got = sorted(map(repr, readers.scan_json(spark, str(folder), schema).collect()))
        cuts(1 << 27)
        want = sorted(map(repr, readers.scan_json(spark, str(folder), schema, split=False).collect()))
        assert got == want and len(want) > 1, (k, size)


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.load_tickets(spark, str(tmp_path / "none.csv"))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError, match="unsupported suffix"):
        readers.load_tickets(spark, str(tmp_path / "a.txt"))
    (tmp_path / "a.csv").write_text("ticket_id,body\n1,x\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.load_tickets(spark, str(tmp_path / "a.csv"))
    assert readers.scan_tickets(spark, str(tmp_path / "a.csv"), text="body").columns == ["ticket_id", "text"]


def test_ticket_source_shares(spark):
    tickets = Source(spark, FOLDER).tickets
    n = tickets.count()
    assert tickets.select("ticket_id").distinct().count() == n
    shares = {r["category"]: r["count"] / n for r in tickets.groupBy("category").count().collect()}
    assert shares == pytest.approx({"billing": 0.2, "shipping": 0.2, "product_quality": 0.2, "technical_support": 0.25, "returns": 0.15}, abs=0.01)
    assert tickets.filter(F.col("text").rlike(r"\{[a-z]+\}")).count() == 0


def test_keys_longer_than_the_padding_stay_distinct(spark):
    from ticketlens.sources.sample import pad_key

    df = spark.createDataFrame([(7,), (123456789,), (1234567890,)], "k bigint").select(pad_key(F.col("k")).alias("p"))
    assert [r["p"] for r in df.collect()] == ["00000007", "123456789", "1234567890"]


def test_writers(spark, tmp_path):
    info = spark.createDataFrame([(0, 3, "0_a", ["a", "b"])], "topic int, count bigint, name string, keywords array<string>")
    writers.write_topic_summary(info, str(tmp_path / "t"), "csv")
    assert readers.scan_csv(spark, str(tmp_path / "t")).first()["keywords"] == '["a","b"]'
    with pytest.raises(ValueError):
        writers.write_enriched(info, str(tmp_path / "x"), "xml")
    empty = spark.createDataFrame([], "ticket_id string, entity string, entity_type string")
    writers.write_entity_summary(empty, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 0
    run = writers.write_report(info, str(tmp_path / "r"), "run1")
    writers.write_report(info, str(tmp_path / "r"), "run2")
    assert run == "run1" and spark.read.parquet(str(tmp_path / "r")).select("run_id").distinct().count() == 2


def test_weekly_run_and_report_from_the_enriched_table(spark, tmp_path):
    s = Source(spark, FOLDER)
    out = str(tmp_path / "run")
    result = run_weekly(spark, s.tickets, out, WeeklyConfig(names=s.names, topic_counts=(5,), n_topics=3))
    assert result.errors == [] and result.n_tickets == 1500
    assert set(result.paths) == {"topic_summary", "entity_summary", "enriched_tickets", "report"}
    enriched = spark.read.parquet(result.paths["enriched_tickets"])
    assert enriched.count() == 1500 and enriched.filter("topic >= 0").select("topic").distinct().count() == 3
    again = readers.load_enriched(spark, result.paths["enriched_tickets"])
    again.threshold = -0.7
    first = spark.read.parquet(result.paths["report"]).filter("name = 'executive_summary'").orderBy("ord").select("key", "value").collect()
    second = rp.report_facts(again).filter("name = 'executive_summary'").orderBy("ord").select("key", "value").collect()
    assert first == second


@pytest.mark.parametrize("name", ["load_enriched", "write_enriched"])
def test_enriched_tables_are_built_from_written_tickets(spark, monkeypatch, name):
    seen, write = [], writers.write_enriched

    def noted(df, path):
        seen.append(df)
        return write(df, path)

    monkeypatch.setattr(writers, "write_enriched", noted)
    QUERIES[name](spark, FOLDER)
    assert len(seen) == 1 and not [f for f in seen[0].inputFiles() if "orders" in f]


def test_weekly_run_goes_on_after_a_failed_stage(spark, tmp_path):
    def broken(df):
        raise RuntimeError("no model today")

    tickets = Source(spark, FOLDER).tickets
    config = WeeklyConfig(topic_counts=(2,), sentiment_model=broken, reporting_period_days=30)
    result = run_weekly(spark, tickets, str(tmp_path / "run"), config)
    assert result.errors == ["sentiment failed: no model today"]
    facts = spark.read.parquet(result.paths["report"])
    assert facts.filter("name = 'sentiment_trend' and status = 'no_data'").count() == 1
    assert run_weekly(spark, str(tmp_path / "none.csv"), str(tmp_path / "x")).errors[0].startswith("load failed")
    with pytest.raises(RuntimeError):
        run_weekly(spark, tickets, str(tmp_path / "y"), WeeklyConfig(topic_counts=(2,), sentiment_model=broken, continue_on_error=False))


def test_streams_equal_the_batch(spark, tmp_path):
    s = Source(spark, FOLDER)
    s.tickets.withColumn("created_at", F.col("created_at").cast("string")).write.json(str(tmp_path / "in"))
    stream = scoring.score_stream(scoring.read_ticket_stream(spark, str(tmp_path / "in"), readers.TICKET_SCHEMA), normalise=False)
    query = scoring.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    columns = ["ticket_id", "sentiment_label", "lex_compound", "is_critical"]
    got = spark.read.parquet(str(tmp_path / "out")).select(columns)
    assert got.exceptAll(s.scored.select(columns)).count() == 0 and got.count() == 1500

    trend = scoring.daily_trend_stream(scoring.score_stream(
        scoring.read_ticket_stream(spark, str(tmp_path / "in"), readers.TICKET_SCHEMA), normalise=False), late="0 seconds")
    query = scoring.write_stream(trend, str(tmp_path / "trend"), str(tmp_path / "cp2"))
    query.awaitTermination(120)
    from ticketlens.operators.trends import period_trend
    from ticketlens.functions.text import round_mean

    batch = period_trend(s.scored).select("period", round_mean(F.col("mean_compound")).alias("mean_compound"), "ticket_count")
    closed = spark.read.parquet(str(tmp_path / "trend"))
    assert closed.count() >= batch.count() - 2 and closed.exceptAll(batch).count() == 0
