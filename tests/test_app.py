import json
import threading
import urllib.error
import urllib.request
from http.server import HTTPServer

import pytest

from lexloom import app, models
from lexloom.operators import evaluate


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    (folder / "penal_code.txt").write_text("Article 1: Theft is punished by a fine.\nArticle 2: Fraud is punished by prison for three years.")
    s = app.Service(spark, str(tmp_path_factory.mktemp("store")))
    assert s.ingest(str(folder))["total_chunks"] == 2
    return s


def test_ask(service):
    got = service.ask("How is theft punished by a fine?")
    assert "Theft" in got["answer"] and got["sources"][0]["article_number"] == "1" and got["sources"][0]["law_name"].startswith("UAE Federal Penal")


def test_http(service):
    server = HTTPServer(("127.0.0.1", 0), app.handler(service))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert json.load(urllib.request.urlopen(f"{url}/api/health"))["status"] == "healthy"
        assert json.load(urllib.request.urlopen(f"{url}/api/stats"))["vector_store"]["total_chunks"] == 2
        assert b"<form" in urllib.request.urlopen(url + "/").read()
        ask = lambda body: urllib.request.urlopen(urllib.request.Request(f"{url}/api/query", body))
        assert "prison" in json.load(ask(b'{"query": "fraud is punished by prison"}'))["answer"]
        for body in (b'{"query": " "}', b"[]", b"x"):
            with pytest.raises(urllib.error.HTTPError) as e:
                ask(body)
            assert e.value.code == 400
    finally:
        server.shutdown()


def test_body(spark, service):
    got = service.ask("How is theft punished by a fine?")
    assert set(got) == {"query", "answer", "sources", "confidence", "hallucination_flags", "timing"} and got["hallucination_flags"] == []
    assert set(got["timing"]) == {"retrieval", "generation", "total"} and 0 < got["timing"]["retrieval"] < got["timing"]["total"]
    assert all(set(x) == {"text", "law_name", "article_number", "chapter", "score"} and x["score"] == round(x["score"], 4) for x in got["sources"]) and got["sources"]
    assert service.ask("zzz qqq")["sources"] == [] and service.ask("zzz qqq")["confidence"] == 0


def test_hybrid_reranked_and_verified(spark, service):
    from dataclasses import replace

    config = replace(service.config, retrieval="hybrid", rerank=True, verify_answers=True)

    class Inventive:
        def complete(self, prompt):
            return "[]" if prompt.startswith("List") else "Theft is punished by a fine. Kidnapping leads to Article 99 banishment overseas."

    s = app.Service(spark, service.collection.path.rpartition("/")[0], config, Inventive())
    got = s.ask("How is theft punished by a fine?")
    assert [x["article_number"] for x in got["sources"]][0] == "1" and any("banishment" in x for x in got["hallucination_flags"])
    plain = app.Service(spark, service.collection.path.rpartition("/")[0], replace(config, verify_answers=False), Inventive()).ask("How is theft punished by a fine?")
    assert got["confidence"] == pytest.approx(0.7 * plain["confidence"], abs=2e-3)


def test_baseline_times_are_measured(service, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"question": "theft is punished by a fine"}, {"question": "qqq zzz"}]))
    got = service.baseline(str(tmp_path / "q.json"), str(tmp_path / "out"))
    assert (got["succeeded"], got["failed"]) == (1, 1) and got["mean_seconds"] > 0 and got["mean_confidence"] > 0


def test_evaluate(service, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "query": "theft is punished by a fine", "category": "simple", "difficulty": "easy", "expected_articles": ["1"]}]))
    (tmp_path / "t.json").write_text(json.dumps([{"query_id": "1", "relevant_articles": ["1"]}]))
    r = service.evaluate(str(tmp_path / "q.json"), str(tmp_path / "t.json")).first()
    assert not r.failed and r.context_recall == 1.0 and r.faithfulness == 1.0


class Checking:
    def complete(self, prompt):
        return '["it is free"]' if prompt.startswith("List, as a JSON array") else "Theft is punished by a fine and it is free."


class Failing(Checking):
    def complete(self, prompt):
        if prompt.startswith("List"):
            raise OSError("no reply")
        return super().complete(prompt)


def test_model_checks_its_answers(spark, service, tmp_path):
    ask = lambda model: app.Service(spark, service.collection.path.rpartition("/")[0], service.config, model).ask("theft is punished by a fine")
    checked, failed = ask(Checking()), ask(Failing())
    assert checked["answer"] == failed["answer"] and checked["confidence"] == pytest.approx(0.7 * failed["confidence"], abs=2e-3) and failed["confidence"] > 0
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "query": "theft is punished by a fine", "category": "simple", "difficulty": "easy", "expected_articles": ["1"]}]))
    (tmp_path / "t.json").write_text("[]")
    scored = app.Service(spark, service.collection.path.rpartition("/")[0], service.config, Checking()).evaluate(str(tmp_path / "q.json"), str(tmp_path / "t.json"))
    assert evaluate.flagged(scored).count() == 1


def test_models():
    assert models.text_model("ollama", model="m").model == "m"
    with pytest.raises(ValueError):
        models.text_model("other")
