from dataclasses import replace

import pytest

from ticketlens.operators import entities as en
from ticketlens.operators import sentiment as se
from ticketlens.operators import topic_model as tm
from ticketlens.plans.catalog import Source
from ticketlens.plans.weekly import WeeklyConfig, run_weekly
from ticketlens.sources import writers


class Killed(BaseException):
    pass


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "tickets.parquet")
    Source(spark, "/root/testdata/sf0.001").tickets.limit(150).coalesce(1).write.parquet(path)
    return path


def tables(spark, out):
    names = ("topic_summary", "entity_summary", "enriched_tickets")
    return {n: sorted(map(repr, spark.read.parquet(f"{out}/{n}").collect())) for n in names}


def kill(*_, **__):
    raise Killed


def test_a_killed_run_goes_on(spark, source, tmp_path, monkeypatch):
    out, config = str(tmp_path / "run"), WeeklyConfig(topic_counts=(2,), resume=True)
    finished = ["tickets"]
    for module, name, after in ((tm, "fit_topics", ["topics", "topic_info", "topic_summary"]), (se, "analyze_sentiment", ["sentiment", "entities"]),
                                (writers, "write_entity_summary", ["entity_summary", "enriched_tickets"]), (writers, "write_report", ["report"])):
        with monkeypatch.context() as patch:
            patch.setattr(module, name, kill)
            with pytest.raises(Killed):
                run_weekly(spark, source, out, config)
        finished += after
    result = run_weekly(spark, source, out, config)
    assert result.errors == [] and result.reused == finished[:-1] and result.n_tickets == 150
    again = run_weekly(spark, source, out, config)
    assert again.reused == finished and set(again.paths) == set(result.paths)
    before = tables(spark, out)
    assert all(before.values())
    # Another limit for amounts concerns the entity summary alone; another lexicon weight the scores and what reads them.
    assert set(finished) - set(run_weekly(spark, source, out, replace(config, critical_money_threshold=5.0)).reused) == {"entity_summary"}
    changed = set(finished) - set(run_weekly(spark, source, out, replace(config, critical_money_threshold=5.0, hybrid_alpha=0.7)).reused)
    assert changed == {"sentiment", "enriched_tickets", "report"}
    assert run_weekly(spark, source, out, replace(config, resume=False)).reused == []
    assert tables(spark, out) == before


def test_a_changed_input_is_read_again(spark, source, tmp_path):
    out, config = str(tmp_path / "run"), WeeklyConfig(topic_counts=(2,), resume=True, with_entities=False)
    df = spark.read.parquet(source)
    run_weekly(spark, df.limit(100), out, config)
    assert "tickets" in run_weekly(spark, df.limit(100), out, config).reused
    result = run_weekly(spark, df.limit(99), out, config)
    assert result.reused == [] and result.n_tickets == 99


def test_a_failed_stage_is_made_up_for(spark, source, tmp_path, monkeypatch):
    out, config = str(tmp_path / "run"), WeeklyConfig(topic_counts=(2,), resume=True)
    with monkeypatch.context() as patch:
        patch.setattr(en, "entity_mentions", lambda *_, **__: 1 / 0)
        assert any(e.startswith("entities failed") for e in run_weekly(spark, source, out, config).errors)
    result = run_weekly(spark, source, out, config)
    assert result.errors == [] and "topics" in result.reused and not {"entities", "enriched_tickets", "report"} & set(result.reused)
