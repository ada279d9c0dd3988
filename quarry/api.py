"""Requests as a service takes them, the service itself, and a command line.

A request is {dataset, length, query, tokenize}; ``dataset`` names an entry of the
catalog, never a path.
"""

from __future__ import annotations

import argparse
import csv
import html
import io
import json
import logging
import time
import zlib
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import corpus as corpora
from quarry.operators import search, suffix_index, tokens
from quarry.sources import decode_base64_tokens, named, needles, number_rows, parse_request, read_corpus, read_needles, with_next, write_results

log = logging.getLogger(__name__)


class RequestError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Service:
    """Datasets by name: corpora (uid, text), suffix indexes of some, and for token requests (uid, tokens).

    A dataset with an index is searched in it; others are scanned.
    """

    def __init__(self, spark: SparkSession, datasets: dict[str, DataFrame], token_sets: dict[str, DataFrame] | None = None, indexes: dict[str, DataFrame] | None = None):
        self.spark, self.datasets, self.token_sets, self.indexes = spark, datasets, token_sets or {}, indexes or {}

    def _request(self, body: str) -> dict:
        try:
            request = parse_request(body)
        except (ValueError, AttributeError, TypeError) as e:
            raise RequestError(400, f"bad request: {e}") from None
        if not request["query"]:
            raise RequestError(400, "an empty query matches everywhere")
        if request["dataset"] not in (self.token_sets if request["tokenize"] else self.datasets):
            raise RequestError(404, f"no dataset {request['dataset']!r}")
        return request

    def _token_hits(self, request: dict) -> DataFrame:
        try:
            ids = decode_base64_tokens(request["query"])
        except ValueError as e:
            raise RequestError(500, str(e)) from None
        return tokens.token_positions(self.token_sets[request["dataset"]], ids)

    def count(self, body: str) -> str:
        """The JSON response of a count request."""
        request, began = self._request(body), time.time()
        name, query = request["dataset"], request["query"]
        if request["tokenize"]:
            out = json.dumps({"occurrences": self._token_hits(request).count(), "before": None, "query": query, "after": None})
        else:
            asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
            corpus = self.datasets[name]
            if name in self.indexes:  # context of its hits from the documents that have any
                hits = suffix_index.look_up(self.indexes[name], query, corpus).select("uid").distinct()
                corpus = with_next(corpus, "uid").join(hits, "uid", "left_semi")
            out = search.responses(corpus, asked).first()["response"]
        log.info("QUERY %r COUNT_TIME %.3f", query, time.time() - began)
        return out

    def csv_lines(self, body: str) -> Iterator[str]:
        """Document id and text of every hit, as lines of CSV without a header; rows come from the executors one partition at a time."""
        request, began = self._request(body), time.time()
        name, query = request["dataset"], request["query"]
        if request["tokenize"]:
            rows = self._token_hits(request).join(self.token_sets[name], "uid").select("uid", F.to_json("tokens").alias("document"))
        else:
            asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
            found = suffix_index.retrieve_all(self.indexes[name], asked, self.datasets[name]) if name in self.indexes else search.retrieve(self.datasets[name], asked)
            rows = found.select("doc_id", "document")

        def lines():
            for row in rows.toLocalIterator():
                out = io.StringIO()
                csv.writer(out, lineterminator="\n").writerow(row)
                yield out.getvalue()
            log.info("QUERY %r CSV_TIME %.3f", query, time.time() - began)

        return lines()

    def csv(self, body: str) -> str:
        return "".join(self.csv_lines(body))

    def page(self) -> str:
        """A form for count requests, without any script of others."""
        options = "".join(f"<option>{html.escape(n)}</option>" for n in sorted(self.datasets))
        return PAGE.replace("{options}", options)

    def serve(self, port: int = 8081) -> HTTPServer:
        service = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self, status: int, kind: str, raw: bytes) -> None:
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def do_POST(self):  # noqa: N802
                try:
                    body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
                    if self.path == "/count":
                        return self.answer(200, "application/json", service.count(body).encode())
                    if self.path != "/csv":
                        raise RequestError(404, "no such page")
                    lines = service.csv_lines(body)
                except RequestError as e:
                    return self.answer(e.status, "text/plain", str(e).encode())
                self.send_response(200)
                self.send_header("Content-Type", "text/csv")
                self.send_header("Connection", "close")  # the end of the lines is the end of the answer
                self.end_headers()
                for line in lines:
                    self.wfile.write(line.encode())

            def do_GET(self):  # noqa: N802
                pages = {"/": ("text/html; charset=utf-8", service.page), "/about": ("text/plain; charset=utf-8", lambda: ABOUT), "/datasets": ("application/json", lambda: json.dumps({"datasets": sorted(service.datasets)}))}
                if self.path not in pages:
                    return self.answer(404, "text/plain", b"no such page")
                kind, make = pages[self.path]
                self.answer(200, kind, make().encode())

        return HTTPServer(("127.0.0.1", port), Handler)


ABOUT = """Exact substring search over text corpora.

POST /count and /csv take {"dataset", "length", "query", "tokenize"}; counts are of bytes
and overlap, context is up to 128 bytes on each side of the first 64 hits in suffix order.
"""

PAGE = """<!doctype html><title>quarry</title>
<form id=f><select name=dataset>{options}</select> <input name=query required> <button>count</button></form><p id=n><ul id=hits></ul>
<script>
f.onsubmit = async e => {
  e.preventDefault();
  const body = JSON.stringify(Object.fromEntries(new FormData(f)));
  const r = await (await fetch("/count", {method: "POST", body})).json();
  n.textContent = r.occurrences;
  hits.replaceChildren(...(r.before || []).map((b, i) => {
    const li = document.createElement("li"), bold = document.createElement("b");
    bold.textContent = r.query;
    li.append("..." + b, bold, r.after[i] + "...");
    return li;
  }));
};
</script>"""


def whole_words(texts: list[str]) -> list[list[int]]:
    """Ids of words by a hash of each, for searches that must begin and end at words."""
    return [[zlib.crc32(w.encode()) & 0x7FFFFFFF for w in t.split()] for t in texts]


def main(argv: list[str] | None = None) -> int:
    """quarry: load, count, csv, stats, index or serve over a corpus."""
    parser = argparse.ArgumentParser(prog="quarry", description=main.__doc__)
    parser.add_argument("action", choices=["load", "count", "csv", "stats", "index", "serve"])
    parser.add_argument("--data", required=True, help="path of the corpus")
    parser.add_argument("--kind", default="parquet", choices=["parquet", "json", "csv", "text"])
    parser.add_argument("--subset", help="folder of a subset below the data")
    parser.add_argument("--split", help="value of the column 'split'")
    parser.add_argument("--text-key", default="text")
    parser.add_argument("--uid", default=None, help="id column; without it documents are numbered in the order of their text")
    parser.add_argument("--file", help="query file")
    parser.add_argument("--query", action="append", default=[])
    parser.add_argument("--tokenize", action="store_true", help="search whole words in place of bytes")
    parser.add_argument("--index", help="path of an index that 'index' wrote: count, csv and serve then use it")
    parser.add_argument("--out", help="where load, csv and index write")
    parser.add_argument("--port", type=int, default=8081)
    args = parser.parse_args(argv)
    from quarry.session import local_session

    spark = SparkSession.getActiveSession() or local_session()
    path = f"{args.data.rstrip('/')}/{args.subset}" if args.subset else args.data
    where = "split = '{}'".format(args.split.replace("'", "''")) if args.split else None
    docs = read_corpus(spark, path, args.kind, args.text_key, where)
    docs = docs.select(F.col(args.uid).cast("long").alias("uid"), "text") if args.uid else number_rows(docs.select("text"), ["text"])
    asked = read_needles(spark, args.file) if args.file else needles(spark, args.query)
    index = suffix_index.load(spark, args.index) if args.index else None
    began = time.time()
    if args.action == "load":
        docs.write.mode("overwrite").parquet(args.out)
        print(f"{args.out}: {spark.read.parquet(args.out).count()} documents")
    elif args.action == "count":
        if args.tokenize:
            words = tokens.tokenize_with(docs, lambda: whole_words)
            for r in asked.orderBy("query_id").toLocalIterator():
                print(f"{r['query']}: {tokens.token_count(words, whole_words([r['query']])[0]).first()[0]}")
        else:
            found = suffix_index.count_all(index, asked, docs) if index is not None else search.count(docs, asked)
            for r in found.orderBy("query_id").toLocalIterator():
                print(f"{r['query']}: {r['occurrences']}")
        print(f"{time.time() - began:.2f} s")
    elif args.action == "csv":
        out = args.out or (args.file or "queries").rsplit(".", 1)[0] + "-results.csv"
        found = suffix_index.retrieve_all(index, asked, docs) if index is not None else search.retrieve(docs, asked)
        write_results(found.toDF("queryID", "query", "docID", "document"), out)
        print(out)
    elif args.action == "stats":
        corpora.statistics(docs).show(truncate=False)
    elif args.action == "index":
        suffix_index.build(docs, args.out)
        print(suffix_index.validate(suffix_index.load(spark, args.out), docs).first())
    else:
        words = {"default": tokens.tokenize_with(docs, lambda: whole_words)} if args.tokenize else {}
        Service(spark, {"default": docs}, words, {"default": index} if index is not None else {}).serve(args.port).serve_forever()
    return 0


__all__ = ["RequestError", "Service", "main", "named", "whole_words"]
