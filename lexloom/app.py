"""Command line and a small HTTP service around the plans.

    python -m lexloom.app ingest FOLDER STORE [--strategy article]
    python -m lexloom.app ask STORE QUESTION...
    python -m lexloom.app baseline STORE QUESTIONS.json OUT
    python -m lexloom.app evaluate STORE QUERIES.json TRUTH.json REPORT.md
    python -m lexloom.app serve STORE [--port 5000]
"""

from __future__ import annotations

import argparse
import json
import logging
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.config import EngineConfig
from lexloom.log import event, timed
from lexloom.operators import chunking, dense, embedding, evaluate, fusion, generation
from lexloom.plans import rag
from lexloom.session import build_session
from lexloom.sources import readers, sinks

SOURCES = "array<struct<rank:bigint,score:double,chunk_id:string,article_number:string,law_name:string,source:string,text:string,chapter:string>>"
PAGE = """<!doctype html><meta charset="utf-8"><title>Legal questions</title><h1>Legal questions</h1><form id="f"><input id="q" size="60"><button>Ask</button></form><div id="a"></div>
<script>const esc=t=>String(t).replace(/[&<>"]/g,c=>({'&':'&amp;','<':'&lt;','>':'&gt;','"':'&quot;'}[c])),
md=t=>esc(t).replace(/\\*\\*(.+?)\\*\\*/g,'<b>$1</b>').replace(/`(.+?)`/g,'<code>$1</code>').replace(/\\n/g,'<br>'),band=c=>c>=0.7?'high':c>=0.4?'medium':'low';
f.onsubmit=async e=>{e.preventDefault();const r=await fetch('/api/query',{method:'POST',headers:{'Content-Type':'application/json'},body:JSON.stringify({query:q.value})});
const j=await r.json();a.innerHTML=j.error?esc(j.error):'<p>'+md(j.answer)+'</p><p class="'+band(j.confidence)+'">confidence '+band(j.confidence)+' ('+Math.round(j.confidence*100)+' %), '+j.timing.total+' s</p>'
+(j.hallucination_flags.length?'<p>not supported:</p><ul>'+j.hallucination_flags.map(x=>'<li>'+esc(x)+'</li>').join('')+'</ul>':'')
+j.sources.map(s=>'<details><summary>'+esc(s.law_name)+', Article '+esc(s.article_number)+' ('+Math.round(s.score*100)+' %)</summary>'+md(s.text)+'</details>').join('')}</script>"""


class Service:
    """Questions against one collection."""

    def __init__(self, spark: SparkSession, store: str, config: EngineConfig | None = None, model: generation.TextModel | None = None):
        self.spark, self.config, self.model = spark, config or EngineConfig.from_env(), model
        self.collection = sinks.Collection(spark, store, self.config.collection)
        self.embedder = embedding.HashingEmbedder(self.config.embedding_dimension)

    def ingest(self, folder: str, strategy: str = "article") -> dict:
        docs = readers.directory(self.spark, folder)
        if not docs.limit(1).count():
            raise ValueError(f"no documents in {folder}")
        with timed("ingest", folder=folder, strategy=strategy):
            self.collection.replace(rag.ingest(docs, strategy, self.embedder, self.config))
        stats = chunking.stats(self.collection.read()).first().asDict()
        return {**self.collection.stats(), **stats}

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score, rank) by the configured retrieval, reranked if configured so."""
        chunks, c = self.collection.read(), self.config
        if c.retrieval == "hybrid":
            found = rag.hybrid(chunks, queries, self.embedder, c)
        else:
            found = dense.retrieve(chunks, embedding.embed(queries, self.embedder, "query"), c.top_k, c.similarity_threshold, id_col="chunk_id")
        if not c.rerank:
            return found
        rows = found.join(chunks.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
        return fusion.rerank(rows, c.top_k).select("query_id", "chunk_id", F.coalesce("reranker_score", "original_score").alias("score"), "rank")

    def responses(self, queries: DataFrame, found: DataFrame | None = None) -> DataFrame:
        """(query_id, query, answer, confidence, source_count, context, flags, sources) of each query; ``found`` is what was retrieved, if it was."""
        chunks = self.collection.read()
        found = self.retrieve(queries) if found is None else found
        answers = rag.answer(chunks, queries, found, self.model)
        if self.config.verify_answers:
            answers = rag.verified(answers, self.config)
        have = [F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in ("article_number", "law_name", "source", "text", "chapter")]
        sources = found.join(chunks.select("chunk_id", *have), "chunk_id").groupBy("query_id").agg(
            F.sort_array(F.collect_list(F.struct("rank", "score", "chunk_id", "article_number", "law_name", "source", "text", "chapter"))).alias("sources"))
        return answers.join(sources, "query_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast(SOURCES)))

    def ask(self, question: str) -> dict:
        """The answer to one question as the service's JSON body; its times are measured."""
        queries = self.spark.createDataFrame([(0, question)], "query_id long, query string")
        with timed("retrieve", query=question[:100]) as retrieval:
            found = self.retrieve(queries).persist()
            n = found.count()
        with timed("generate", query=question[:100], sources=n) as generation:
            answer = self.responses(queries, found).persist()
            answer.count()
        try:
            times = {"retrieval_time": F.lit(retrieval["seconds"]), "generation_time": F.lit(generation["seconds"])}
            return json.loads(sinks.response_json(answer.withColumnRenamed("flags", "hallucination_flags").withColumns(times)).first().body)
        finally:
            answer.unpersist()
            found.unpersist()

    def baseline(self, questions: str, out: str) -> dict:
        """Answers to a file of questions, written to ``out``; counts, mean confidence and mean seconds of a question, as the whole run took."""
        asked = self.spark.read.option("multiLine", True).schema("question string").json(questions).select(F.monotonically_increasing_id().alias("query_id"), F.col("question").alias("query"))
        with timed("baseline", questions=questions) as run:
            sinks.baseline_results(self.responses(asked), out)
        done = self.spark.read.schema("source_count long, confidence double").json(out)
        each = run["seconds"] / max(1, done.count())
        return json.loads(evaluate.baseline_summary(done.select((F.col("source_count") > 0).alias("success"), "confidence", F.lit(each).alias("seconds"))).toJSON().first())

    def evaluate(self, queries: str, truth: str) -> DataFrame:
        asked = readers.test_queries(self.spark, queries)
        numbered = asked.select(F.xxhash64("id").alias("query_id"), "id", "query")
        got = self.responses(numbered.select("query_id", "query")).join(numbered.select("query_id", "id"), "query_id")
        sources = F.transform("sources", lambda s: F.struct(s["article_number"].alias("article_number"), s["law_name"].alias("law_name"), s["source"].alias("source"), s["text"].alias("text")))
        got = got.select("id", "answer", sources.alias("sources"), "flags", F.lit(None).cast("string").alias("error"))
        return evaluate.per_query(asked, readers.ground_truth(self.spark, truth), got)


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body, kind: str = "application/json") -> None:
            data = (body if isinstance(body, str) else json.dumps(body, ensure_ascii=False)).encode()
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            if self.path == "/":
                self._send(200, PAGE, "text/html")
            elif self.path == "/api/health":
                self._send(200, {"status": "healthy", "service": "lexloom", "pipeline_loaded": True})
            elif self.path == "/api/stats":
                try:
                    self._send(200, {"vector_store": service.collection.stats(), "pipeline_loaded": True})
                except Exception as error:  # noqa: BLE001  the service goes on
                    self._send(500, {"error": str(error)[:500]})
            else:
                self._send(404, {"error": "not found"})

        def do_POST(self):
            if self.path != "/api/query":
                return self._send(404, {"error": "not found"})
            try:
                question = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))["query"].strip()
            except (ValueError, KeyError, TypeError, AttributeError):
                question = ""
            if not question:
                return self._send(400, {"error": "a query is needed"})
            try:
                self._send(200, service.ask(question))
            except Exception as error:  # noqa: BLE001  the service goes on
                self._send(500, {"error": "the query failed", "details": str(error)[:500]})

        def log_message(self, form, *args):
            event("http", line=form % args)

    return Handler


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("ingest", "ask", "baseline", "evaluate", "serve"))
    parser.add_argument("args", nargs="+")
    parser.add_argument("--strategy", default="article")
    parser.add_argument("--port", type=int, default=5000)
    a = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = build_session()
    if a.command == "ingest":
        print(json.dumps(Service(spark, a.args[1]).ingest(a.args[0], a.strategy)))
        return
    service = Service(spark, a.args[0])
    if a.command == "ask":
        print(json.dumps(service.ask(" ".join(a.args[1:])), ensure_ascii=False, indent=2))
    elif a.command == "baseline":
        print(json.dumps(service.baseline(a.args[1], a.args[2])))
    elif a.command == "evaluate":
        with open(a.args[3], "w", encoding="utf-8") as out:
            out.write(evaluate.markdown_report(service.evaluate(a.args[1], a.args[2])))
    else:
        HTTPServer(("127.0.0.1", a.port), handler(service)).serve_forever()


if __name__ == "__main__":
    main()
