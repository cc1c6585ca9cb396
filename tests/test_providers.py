import json
import threading
import time
import urllib.error
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from loomgraph import providers
from loomgraph.plans.engine import Engine
from tests.test_engine import scripted
from tests.test_store import notes
from loomgraph.config import EngineConfig
from loomgraph.operators import answer, extract


def http(pause=0.0, tries=3):
    return providers.Http("http://localhost:1", 1, tries, pause)


def failing(times, error):
    """send() that fails so often before it answers; counts its calls."""
    calls = []

    def send(self, path, payload):
        calls.append(path)
        if len(calls) <= times:
            raise error
        return {"embedding": [1.0, 2.0], "response": "said"}

    return calls, send


def status(code):
    return urllib.error.HTTPError("http://x", code, "no", {}, None)


@pytest.mark.parametrize("times, error, tries, calls, comes", [(2, TimeoutError(), 3, 3, True), (2, TimeoutError(), 2, 2, False), (1, status(503), 3, 2, True), (1, status(404), 3, 1, False), (9, urllib.error.URLError("down"), 3, 3, False)])
def test_retries(monkeypatch, times, error, tries, calls, comes):
    seen, send = failing(times, error)
    monkeypatch.setattr(providers.Http, "send", send)
    if comes:
        assert http(tries=tries).post("/p", {})["response"] == "said"
    else:
        with pytest.raises(type(error)):
            http(tries=tries).post("/p", {})
    assert len(seen) == calls


def test_pauses_double(monkeypatch):
    _, send = failing(3, TimeoutError())
    slept = []
    monkeypatch.setattr(providers.Http, "send", send)
    monkeypatch.setattr(providers.time, "sleep", slept.append)
    http(pause=2.0, tries=4).post("/p", {})
    assert slept == [2.0, 4.0, 8.0]


def test_a_server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"embedding": [float(len(asked["prompt"])), 0.0]} if self.path.endswith("embeddings") else {"response": f"{asked['model']}|{asked['prompt']}|{asked.get('format')}|{asked.get('system')}"}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("localhost", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    config = EngineConfig().with_(models={"provider": "http", "url": f"http://localhost:{server.server_port}/", "dimensions": 2, "embedding": "e", "answering": "talker"})
    assert providers.embedder(config).embed_one("abc") == [3.0, 0.0]
    assert providers.language_model(config, "ranking").complete("hi", system="be kind") == "talker|hi|None|be kind"
    assert providers.language_model(config, "ranking").complete_json("hi") == "talker|hi|json|None"
    with pytest.raises(ValueError, match="where 3 were set"):
        providers.embedder(config.with_(models={"dimensions": 3})).embed_one("abc")
    server.shutdown()
    with pytest.raises(ValueError, match="provider"):
        providers.embedder(config.with_(models={"provider": "magic"}))


def test_calls_overlap_and_keep_their_order():
    def call(n):
        if n == 2:
            raise ValueError("two")
        time.sleep(0.1)
        return n * 10

    ticks = []
    began = time.perf_counter()
    got = providers.mapped(call, list(range(8)), 8, lambda: ticks.append(1))
    took = time.perf_counter() - began
    assert [r for r, _ in got] == [0, 10, None, *range(30, 80, 10)] and got[2][1] == "ValueError: two" and all(e is None for i, (_, e) in enumerate(got) if i != 2)
    assert len(ticks) == 8 and took < 0.35
    assert providers.mapped(call, [1], 1) == [(10, None)] and providers.mapped(call, [], 4) == []


def test_offline_models(spark):
    model = providers.OfflineModel()
    assert model.complete(answer.TASK + " [7] and [2], [11], [2], [30]") == answer.HEAD + "[2] [7] [11]."
    assert model.complete(answer.TASK) == answer.HEAD + "[1]."
    prompt = spark.range(1).select(extract.extraction_prompt(extract.F.lit("The Harbour Master met Ines. Text:\n\nText:\nTide Tables"))).first()[0]
    names = [e["name"] for e in json.loads(model.complete_json(prompt))["entities"]]
    assert names == ["The Harbour", "Master", "Ines", "Text", "Tide Tables"] or "Ines" in names


def test_settings_of_the_environment(tmp_path):
    (tmp_path / "env").write_text("# mine\nLOOMGRAPH_RETRIEVAL_HITS=9\nLOOMGRAPH_MODELS_URL=\"http://a\"\nLOOMGRAPH_RETRIEVAL_RANK=yes\n")
    got = EngineConfig.from_env({"LOOMGRAPH_RETRIEVAL_HITS": "4", "LOOMGRAPH_FACT_SHARE": "0.5", "LOOMGRAPH_CHUNKING_OVERLAP": "7", "OTHER": "x"}, str(tmp_path / "env"))
    assert (got.retrieval.hits, got.models.url, got.retrieval.rank, got.fact_share, got.chunking.overlap) == (4, "http://a", True, 0.5, 7)
    assert EngineConfig.from_env({}, str(tmp_path / "none")) == EngineConfig()


def test_the_server_has_no_defaults():
    http = EngineConfig().with_(models={"provider": "http"})
    for config, name in ((http, "URL"), (http.with_(models={"url": "http://x"}), "EMBEDDING"), (http.with_(models={"url": "http://x", "embedding": "e"}), "ANSWERING")):
        with pytest.raises(ValueError, match=f"LOOMGRAPH_MODELS_{name}"):
            providers.embedder(config)
            providers.language_model(config, "ranking")


class Slow:
    model, dim = "slow", 2

    def embed_one(self, text):
        time.sleep(0.4)
        return [1.0, 0.0]


def test_progress_is_told_while_a_phase_runs(spark, tmp_path):
    ticks = []
    own = Engine(spark, str(tmp_path), EngineConfig().with_(models={"calls": 1}), embed=Slow(), extractor=scripted)
    own.ingest(notes(spark, 0, 40), resolve_after=False, progress=lambda *t: ticks.append(t))
    embed = [t for t in ticks if t[0] == "embed"]
    assert len(embed) > 2 and embed[0] == ("embed", 0, 40) and embed[-1] == ("embed", 40, 40) and embed == sorted(embed)
    assert [t[0] for t in ticks if t[1] == t[2]] == ["embed", "extract", "write"]
