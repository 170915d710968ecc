import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tracelens.operators import dictionary as N
from tracelens.operators import models as M
from tracelens.plans import registry
from tracelens.sources import sinks


def test_algorithms_by_name(spark):
    rows = [(i, "f", i // 50, 10.0 + i % 7) for i in range(200)] + [(1000, "f", 3, 900.0)]
    e = spark.createDataFrame(rows, "id long, func string, step int, exclusive double")
    for name in ("SSTD", "hbos", "COPOD"):
        out = registry.run("performance_analysis", e, M.Params(algorithm=name.lower() if name != "SSTD" else name))
        assert out.count() == 201 and out.where("id = 1000").first()["label"] == -1
    with pytest.raises(ValueError):
        registry.label(e, ["func"], "step", "exclusive", "id", M.Params("other"))


def test_indexes_stay_and_grow(spark):
    seen = lambda *r: spark.createDataFrame(list(r), "pid long, name string, first long")
    none = spark.createDataFrame([], "pid long, name string, fid long")
    one = N.assign(none, seen((0, "b", 5), (0, "a", 7), (0, "b", 9)))
    two = N.assign(one, seen((0, "a", 1), (1, "a", 2)))
    assert {(r["pid"], r["name"]): r["fid"] for r in two.collect()} == {(0, "b"): 0, (0, "a"): 1, (1, "a"): 2}
    local = spark.createDataFrame([(0, 3, "a"), (0, 4, "zzz")], "pid long, id long, name string")
    events = spark.createDataFrame([(0, 3, 10), (0, 4, 11), (0, 5, 12)], "pid long, fid long, ts long")
    good, bad = N.resolved(events, local, two)
    assert good.first()["fid"] == 1 and bad.count() == 2
    with pytest.raises(Exception, match="no name"):
        N.model_names(spark.createDataFrame([(9,)], "fid long"), two.where("pid = 0").drop("pid")).collect()


def test_packets_and_models(spark, tmp_path):
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.createDataFrame([(1, "f")], "n long, func string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long, func string").parquet(str(tmp_path / "in"))
    sinks.packets(stream, lambda _, body: sinks.post(f"http://127.0.0.1:{server.server_port}/", body), checkpoint=str(tmp_path / "c")).awaitTermination()
    server.shutdown()
    assert got[0]["anomaly_stats"] == [{"n": 1, "func": "f"}] and got[0]["version"] == 2
    model = spark.createDataFrame([("f", 3, 1.5)], "func string, n long, mean double")
    sinks.save_model(model, str(tmp_path / "m"))
    assert sinks.load_model(spark, str(tmp_path / "m"), model.schema).collect() == model.collect()
    assert sinks.due(4, 1, 5) and not sinks.due(4, 0, 5) and sinks.due(4, 0, 5, True)
