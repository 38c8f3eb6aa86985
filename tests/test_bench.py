import json


def test_bench_prints_one_json_line(spark, monkeypatch, capsys):
    import bench

    from .conftest import SF_SMALL

    monkeypatch.setenv("BENCH_SF_DIR", SF_SMALL)
    monkeypatch.setattr(bench, "HEADLINE", ["label_trend_month", "nearest_topics"])
    bench.main()
    lines = [ln for ln in capsys.readouterr().out.splitlines() if ln.strip()]
    assert len(lines) == 1
    out = json.loads(lines[0])
    assert out["unit"] == "sec" and out["sf"] == "0.001"
    assert set(out["queries"]) == {"label_trend_month", "nearest_topics"}
    assert out["value"] == round(sum(out["queries"].values()), 3)
