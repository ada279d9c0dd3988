import base64
import json
import re
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.api import RequestError, Service, main
from quarry.functions import pack_tokens, succ, unpack_tokens, valid_body, word_count
from quarry.operators import corpus as corpora
from quarry.operators import search, suffix_index, suffix_order, tokens
from quarry.sources import needles, number_rows, packed, parse_request, read_corpus, read_results, write_results
from quarry.streaming import count_stream

TEXTS = ["aaaa", "The quick brown fox was very quick.", "é ééé x.(y)\n\\E end", "", None, "onononon", "aaaa", "x" * 200 + "quick" + "y" * 200]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(TEXTS)], "uid long, text string")


def brute(needle):
    raw, out = needle.encode(), []
    for i, t in enumerate(TEXTS):
        body = (t or "").encode()
        out += [(i + 1, m.start()) for m in re.finditer(b"(?=" + re.escape(raw) + b")", body)]
    return sorted(out)


@pytest.mark.parametrize("needle", ["aa", "quick", "onon", "éé", ".(", "\\E", "\n", "The quick brown fox was very quick.", "nothing"])
def test_positions_counts_and_index_agree(spark, docs, tmp_path, needle):
    asked = spark.createDataFrame([(0, needle)], "query_id int, query string")
    want = brute(needle)
    assert sorted((r.uid, r.pos) for r in search.positions(docs, asked).collect()) == want
    assert search.count(docs, asked).first().occurrences == len(want)
    assert search.count_of(docs, needle).first()[0] == len(want)
    path = str(tmp_path / "index")
    suffix_index.build(docs, path, 8, 3)
    index = suffix_index.load(spark, path)
    assert sorted(tuple(r) for r in suffix_index.look_up(index, needle, docs, 8).collect()) == want
    assert sorted((r.uid, r.off) for r in suffix_index.look_up_all(index, asked, docs, 8).collect()) == want
    for r in search.kwic(docs, asked).collect():
        body = TEXTS[r.uid - 1].encode()
        assert bytes(r.before) + needle.encode() + bytes(r.after) == body[max(0, r.pos - 128) : r.pos + len(needle.encode()) + 128]


def test_many_needles_agree_with_one_at_a_time(spark, docs, monkeypatch):
    asked = ["aa", "a", "onon", "quick", "qu", "é", "éé", " ", "\\E", "\n", "y", "The quick brown fox was very quick.", "nothing", "aa", "x", "fox"]
    list_ = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    for limit in (search.NEEDLE_BYTES, 6):  # in one part, and in many
        monkeypatch.setattr(search, "NEEDLE_BYTES", limit)
        got = sorted((r.query_id, r.uid, r.pos) for r in search.positions(docs, list_).collect())
        assert got == sorted((i, u, p) for i, q in enumerate(asked) for u, p in brute(q))
        want = sorted({(i, u) for i, q in enumerate(asked) for u, _ in brute(q)})
        assert sorted((r.query_id, r.uid) for r in search.pairs(docs, list_).collect()) == want
        assert sorted((r.query_id, r.uid) for r in search.matches(docs, list_).collect()) == want
        counts = {r.query_id: r.occurrences for r in search.count(docs, list_).collect()}
        assert counts == {i: len(brute(q)) for i, q in enumerate(asked)}
        assert {r.query_id: r.documents for r in search.document_frequency(docs, list_).collect()} == {i: len({u for u, _ in brute(q)}) for i, q in enumerate(asked)}


def test_first_suffixes_with_ties(spark, docs, monkeypatch):
    body = b"ab" * 3000 + b"a" * 700
    at = np.array([m.start() for m in re.finditer(b"(?=a)", body)])
    assert search.first_suffixes(body, at, 64) == sorted(at.tolist(), key=lambda p: body[p:])[:64]
    asked = spark.createDataFrame([(0, "a"), (1, "quick"), (2, "é")], "query_id int, query string")
    flat = {i + 1: (t or "").encode() + (b"" if i + 1 == len(TEXTS) else b"\xff\xff" + (i + 2).to_bytes(4, "little")) for i, t in enumerate(TEXTS)}
    for hits, held in ((3, search.HELD_BYTES), (64, search.HELD_BYTES), (3, 100)):
        monkeypatch.setattr(search, "HELD_BYTES", held)
        got = {(r.query_id, r.k): (r.uid, r.pos) for r in search.kwic_top(docs, asked, hits=hits).collect()}
        for i, q in enumerate(["a", "quick", "é"]):
            want = sorted(brute(q), key=lambda x: (flat[x[0]][x[1] :], x))[:hits]
            assert [got[i, k + 1] for k in range(len(want))] == want and (i, len(want) + 1) not in got


def test_a_long_text_of_half_a_million_hits_takes_seconds(spark):
    one = spark.createDataFrame([(1, "ab" * 500_000)], "uid long, text string")
    asked = spark.createDataFrame([(0, "ab")], "query_id int, query string")
    began = time.time()
    assert search.positions(one, asked).agg(F.count(F.lit(1)), F.max("pos")).first() == (500_000, 999_998)
    assert search.kwic(one, asked).agg(F.sum(F.octet_length("before"))).first()[0] == 499_936 * 128 + sum(range(0, 128, 2))
    # the corpus ends here, so the shortest suffix comes first
    assert [r.pos for r in search.kwic_top(one, asked).orderBy("k").limit(2).collect()] == [999_998, 999_996]
    assert time.time() - began < 60


def test_next_ids_and_offsets_over_many_ranges(spark, monkeypatch):
    import quarry.sources as sources

    monkeypatch.setattr(sources, "RANGE_ROWS", 3)
    ids = [i * i % 997 for i in range(40)] + [5000, 100_000]
    table = spark.createDataFrame([(i, "t" * (i % 7)) for i in sorted(set(ids))], "uid long, text string")
    order = sorted(set(ids))
    assert {r.uid: r.next for r in sources.with_next(table, "uid").collect()} == dict(zip(order, [*order[1:], None]))
    at = 0
    for r in corpora.doc_offsets(table).orderBy("uid").collect():
        assert (r.start_pos, r.end_pos) == (at, at + r.uid % 7 + 6)
        at = r.end_pos
    assert sources.with_next(table.limit(0), "uid").count() == 0 and corpora.doc_offsets(table.limit(0)).count() == 0


def test_empty_needles_are_refused(spark, docs):
    with pytest.raises(ValueError):
        search.count_of(docs, "")
    assert needles(spark, ["a", " ", "\tb\n"]).collect() == [(0, "a"), (2, "b")]
    assert search.contains(docs, "").count() == 0


def test_statistics_offsets_and_validity(spark, docs):
    s = corpora.statistics(docs).first()
    sizes = [len((t or "").encode()) for t in TEXTS]
    assert (s.n_docs, s.body_bytes, s.corpus_bytes, s.valid_docs, s.max_bytes) == (8, sum(sizes), sum(sizes) + 48, 8, max(sizes))
    offsets = sorted(tuple(r) for r in corpora.doc_offsets(docs).select("uid", "start_pos", "end_pos").collect())
    at = 0
    for (uid, a, b), n in zip(offsets, sizes):
        assert (a, b) == (at, at + n + 6)
        at = b
    bad = spark.createDataFrame([(bytearray(b"a\xff\xffb"),)], "text binary")
    assert bad.select(valid_body(F.col("text"))).first()[0] is False


def test_contaminated_and_clean(spark, docs):
    items = spark.createDataFrame([(1, "quick"), (2, "absent")], "query_id int, query string")
    assert [r.query_id for r in search.contaminated(docs, items).collect()] == [1]
    assert [r.query_id for r in search.clean(docs, items).collect()] == [2]
    assert search.document_frequency(docs, items).where("query_id = 1").first().documents == 2


def test_rank_and_lcp_follow_naive_order(spark):
    small = spark.createDataFrame([(1, "banana"), (2, "ana")], "uid long, text string")
    rows = suffix_index.ranked(small).orderBy("rank").collect()
    want = sorted((t[i:].encode(), u, i) for u, t in ((1, "banana"), (2, "ana")) for i in range(len(t)))
    assert [(bytes(r.suffix), r.uid, r.off) for r in rows] == want
    shared = [0] + [next((k for k in range(min(len(a[0]), len(b[0]))) if a[0][k] != b[0][k]), min(len(a[0]), len(b[0]))) for a, b in zip(want, want[1:])]
    assert [r.lcp for r in suffix_index.lcp(suffix_index.ranked(small)).orderBy("rank").collect()] == shared


def test_rank_and_lcp_of_a_corpus_follow_naive_order(spark):
    long = "the same opening, longer than any key, " * 4
    texts = [*TEXTS, long + "a é", long + "a è", long + "a é", "é" * 70, "ab" * 150, long[:32], "z" + long]
    corpus = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "uid long, text string")
    want = sorted((t[i:].encode(), u + 1, len(t[:i].encode())) for u, t in enumerate(texts) for i in range(len(t or "")))
    shared = [0] + [next((k for k, (x, y) in enumerate(zip(a[0], b[0])) if x != y), min(len(a[0]), len(b[0]))) for a, b in zip(want, want[1:])]
    assert [(r.rank, r.uid, r.off) for r in suffix_order.rank_corpus(corpus).orderBy("rank").collect()] == [(i, u, o) for i, (_, u, o) in enumerate(want)]
    assert [(r.rank, r.lcp) for r in suffix_order.lcp_corpus(corpus).orderBy("rank").collect()] == list(enumerate(shared))
    assert suffix_order.rank_corpus(corpus.limit(0)).count() == 0


def test_packed_files_and_their_table(spark, docs, tmp_path):
    for folder in (str(tmp_path / "a"), (tmp_path / "b").as_uri()):
        manifest = packed.write_packed(docs.repartition(3), folder)
        flat = b"".join(b"\xff\xff" + (i + 1).to_bytes(4, "little") + (t or "").encode() for i, t in enumerate(TEXTS))
        assert (manifest["bytes"], manifest["documents"]) == (len(flat), len(TEXTS))
        assert sorted((r.uid, r.text) for r in packed.read_packed(spark, folder).collect()) == [(i + 1, t or "") for i, t in enumerate(TEXTS)]
        packed.write_table(spark, suffix_order.rank_corpus(docs), corpora.doc_offsets(docs), folder)
        index = packed.PackedIndex(folder)
        assert index.slice(0, 10**9) == flat and index.manifest["width"] == 2
        for needle in ("aa", "quick", "onon", "é", "y", "nothing", "aaaa"):
            want = {m.start() for m in re.finditer(b"(?=" + re.escape(needle.encode()) + b")", flat)}
            assert index.count(needle.encode()) == len(want) and set(index.places(needle.encode())) == want
        assert len(index.places(b"a", 2)) == 2
    assert packed.write_packed(docs.limit(0), str(tmp_path / "none"))["documents"] == 0 and packed.read_packed(spark, str(tmp_path / "none")).count() == 0


def test_tokens_are_aligned(spark):
    t = spark.createDataFrame([(1, [1, 2, 1, 2, 1]), (2, [258, 1])], "uid long, tokens array<int>")
    assert sorted(r.token_pos for r in tokens.token_positions(t, [1, 2, 1]).collect()) == [0, 2]
    assert tokens.token_count(t, [2]).first()[0] == 2


def test_service(spark, docs):
    service = Service(spark, {"d": docs})
    got = json.loads(service.count(json.dumps({"Dataset": "d", "query": "quick"})))
    assert got["occurrences"] == 3 and len(got["before"]) == 3
    assert json.loads(service.count(json.dumps({"dataset": "d", "query": "zzz"})))["occurrences"] == 0
    assert service.csv(json.dumps({"dataset": "d", "query": "onon"})).count("onononon") == 3
    for body, status in (("{", 400), ('{"dataset": "d"}', 400), ('{"dataset": "e", "query": "a"}', 404)):
        with pytest.raises(RequestError) as e:
            service.count(body)
        assert e.value.status == status
    assert parse_request('{"QUERY": "a", "Length": 3}')["length"] == 3


def test_service_answers_from_an_index_as_by_scan(spark, docs, tmp_path):
    suffix_index.build(docs, str(tmp_path / "i"))
    index = suffix_index.load(spark, str(tmp_path / "i"))
    by_scan, by_index = Service(spark, {"d": docs}), Service(spark, {"d": docs}, {}, {"d": index})
    for q in ("quick", "aa", "é", "zzz", "The quick brown fox was very quick."):
        body = json.dumps({"dataset": "d", "query": q})
        assert json.loads(by_scan.count(body)) == json.loads(by_index.count(body))
        assert sorted(by_scan.csv(body).splitlines()) == sorted(by_index.csv(body).splitlines())


def test_service_over_http(spark, docs):
    import threading
    import urllib.error
    import urllib.request

    words_ = tokens.tokenize_with(docs, lambda: lambda texts: [[len(w) for w in t.split()] for t in texts])
    server = Service(spark, {"d": docs}, {"t": words_}).serve(0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_address[1]}"
    ask = lambda path, body=None: urllib.request.urlopen(urllib.request.Request(root + path, body and json.dumps(body).encode())).read().decode()
    assert "<option>d</option>" in ask("/") and "/count" in ask("/about") and json.loads(ask("/datasets")) == {"datasets": ["d"]}
    assert json.loads(ask("/count", {"dataset": "d", "query": "quick"}))["occurrences"] == 3
    assert ask("/csv", {"dataset": "d", "query": "onon"}).count("onononon") == 3
    sent = base64.b64encode(bytes([3, 0, 5, 0])).decode()  # a word of three letters, then one of five: "The quick", "ééé x.(y)"
    assert json.loads(ask("/count", {"dataset": "t", "query": sent, "tokenize": True}))["occurrences"] == 2
    for path, body, status in (("/nowhere", None, 404), ("/csv", {"dataset": "e", "query": "a"}, 404), ("/count", {"dataset": "t", "query": "%", "tokenize": True}, 500)):
        with pytest.raises(urllib.error.HTTPError) as e:
            ask(path, body)
        assert e.value.code == status
    server.shutdown()


def test_command_line(spark, docs, tmp_path, capsys):
    docs.selectExpr("uid AS id", "text AS body", "if(uid < 7, 'train', 'test') AS split").write.parquet(str(tmp_path / "data" / "one"))
    (tmp_path / "q.txt").write_text("quick\n\naaaa\nThe quick\n")
    common = ["--data", str(tmp_path / "data"), "--subset", "one", "--text-key", "body", "--uid", "id"]

    def run(*args):
        assert main([*args[:1], *common, *args[1:]]) == 0
        return capsys.readouterr().out

    assert run("count", "--file", str(tmp_path / "q.txt")).splitlines()[:3] == ["quick: 3", "aaaa: 2", "The quick: 1"]
    assert run("count", "--query", "quick", "--split", "train").startswith("quick: 2\n")
    assert run("count", "--query", "quick", "--tokenize").startswith("quick: 1\n")
    run("index", "--out", str(tmp_path / "index"))
    assert run("count", "--query", "aa", "--query", "no", "--index", str(tmp_path / "index")).splitlines()[:2] == ["aa: 6", "no: 3"]
    run("csv", "--query", "quick", "--index", str(tmp_path / "index"), "--out", str(tmp_path / "hits"))
    assert read_results(spark, str(tmp_path / "hits")).count() == 3
    assert run("load", "--out", str(tmp_path / "loaded")).endswith("8 documents\n")
    assert "n_docs" in run("stats")


def test_index_metadata_and_plan(spark, docs, tmp_path):
    suffix_index.build(docs, str(tmp_path / "i"), 8, 3)
    got = suffix_index.metadata(spark, str(tmp_path / "i")).first()
    sizes = [len((t or "").encode()) for t in TEXTS]
    assert (got.documents, got.body_bytes, got.suffixes, got.key_bytes, got.partitions) == (8, sum(sizes), sum(len(t or "") for t in TEXTS), 8, 3)
    assert suffix_index.planned_partitions(0) == 1 and suffix_index.planned_partitions(10**9) == 60 and suffix_index.planned_partitions(5, 8) == 8
    assert suffix_index.validate(suffix_index.load(spark, str(tmp_path / "i")), docs).first() == (got.suffixes, got.suffixes)


def test_ranges_of_keys_hold_all_needles():
    keys = [b"ab", b"abc", b"\xff", b"z\xff", b"b", b"\xff\xff"]
    for most in (1, 2, 10):
        ranges = suffix_index.key_ranges(keys, most)
        assert len(ranges) <= most + 1 and all(any(lo <= k + b"x" and (hi is None or k + b"x" < hi) for lo, hi in ranges) for k in keys)


def test_stream_counts(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    asked = needles(spark, ["aa", "quick"])
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    run = count_stream(stream, asked).writeStream.outputMode("complete").format("memory").queryName("stream_test").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r.query: r.occurrences for r in spark.table("stream_test").collect()} == {"aa": 6, "quick": 3}


def test_tokens_pack_and_unpack(spark):
    t = spark.createDataFrame([(1, [0, 1, 65535]), (2, [])], "uid long, t array<long>")
    got = t.select("t", unpack_tokens(pack_tokens(F.col("t"), 2), 2).alias("u")).collect()
    assert all(r.t == r.u for r in got)
    with pytest.raises(Exception, match="2 bytes"):
        spark.range(1).select(unpack_tokens(F.lit(b"abc"), 2)).collect()


def test_results_survive_csv_and_sources_read(spark, docs, tmp_path):
    asked = spark.createDataFrame([(0, "end")], "query_id int, query string")
    write_results(search.retrieve(docs, asked), str(tmp_path / "r"))
    assert read_results(spark, str(tmp_path / "r")).first().document == TEXTS[2]
    (tmp_path / "a.jsonl").write_text('{"body": "x"}\n')
    assert read_corpus(spark, str(tmp_path), "json", "body").first().text == "x"


def test_small_functions(spark):
    assert succ(b"a\xff") == b"b" and succ(b"\xff") is None and succ(b"ab") == b"ac"
    assert [spark.range(1).select(word_count(F.lit(t))).first()[0] for t in ("a b\tc", "", "  ")] == [3, 0, 0]


def test_numbers_fit_the_ranges_that_were_counted(spark):
    small = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        rows = number_rows(spark.range(0, 20_000, 1, 4).selectExpr("id % 23 AS source", "id AS doc_id"), ["source", "doc_id"]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.uid for r in rows} == set(range(1, 20_001))
    assert [(r.source, r.doc_id) for r in sorted(rows, key=lambda r: r.uid)] == sorted((i % 23, i) for i in range(20_000))


def test_index_takes_fewer_bytes_than_its_text(spark, tmp_path):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("aeinorst"), 5)) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary, 500)) for _ in range(200)]
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "uid long, text string").repartition(2)
    suffix_index.build(corpus, str(tmp_path / "i"), partitions=2)
    assert sum(p.stat().st_size for p in (tmp_path / "i").glob("*.parquet")) < sum(len(t) for t in texts)
    index = suffix_index.load(spark, str(tmp_path / "i"))
    for needle in (texts[7][3:40], texts[7][3:5], vocabulary[3] + " ", "zz", "zzzzz"):
        want = sorted((i, m.start()) for i, t in enumerate(texts) for m in re.finditer(f"(?={needle})", t))
        assert sorted(tuple(r) for r in suffix_index.look_up(index, needle, corpus).collect()) == want
        assert suffix_index.count_of(index, needle, corpus).first()[0] == len(want)


def test_long_matches_count_shared_keys(spark, docs, monkeypatch):
    for key_bytes, size in ((2, 1 << 20), (9, 300)):
        monkeypatch.setattr(suffix_index, "PASS_BYTES", size)
        keys = [t.encode()[len(t[:i].encode()) :][:key_bytes] for t in TEXTS if t for i in range(len(t))]
        sizes = [keys.count(k) for k in set(keys) if len(k) == key_bytes]
        several = [n for n in sizes if n > 1]
        assert tuple(suffix_index.long_matches(docs, key_bytes).first()) == (len(several), sum(several), max(sizes))
    assert tuple(suffix_index.long_matches(docs.limit(0)).first()) == (0, 0, 0)


def test_suffix_order_over_many_ranges_with_long_ties(spark, monkeypatch):
    monkeypatch.setattr(suffix_order, "RANGE_BYTES", 300)
    rng = np.random.default_rng(3)
    long = " ".join(rng.choice(["the", "onon", "é", "aa", "quick"], 300))
    texts = [long, long, long[:700] + "!" + long[700:], long[3:], "z" + long, *["a copy of some length that occurs often, and of more than a few words"] * 9, "a" * 900, "a" * 900, "ab" * 450, "a", "a\0", "a\0\0b", "", None, "\U0001f600é" * 30]
    corpus = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "uid long, text string").repartition(3)
    want = sorted((t[i:].encode(), u + 1, len(t[:i].encode())) for u, t in enumerate(texts) for i in range(len(t or "")))
    shared = [0] + [next((k for k, (x, y) in enumerate(zip(a[0], b[0])) if x != y), min(len(a[0]), len(b[0]))) for a, b in zip(want, want[1:])]
    assert sorted(tuple(r) for r in suffix_order.rank_corpus(corpus).collect()) == [(i, u, o) for i, (_, u, o) in enumerate(want)]
    assert sorted(tuple(r) for r in suffix_order.lcp_corpus(corpus).collect()) == list(enumerate(shared))


def test_suffixes_alike_for_long_are_ranked_by_their_anchors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("aeinorst"), 6)) for _ in range(500)]
    long = [" ".join(rng.choice(vocabulary, 150)) for _ in range(3)]
    texts = [t + end for end in ("", "", "!", " more", "") for t in long]
    corpus = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "uid long, text string").coalesce(2)
    each, _, folder = suffix_order._ranges(corpus)
    read, piece, n = [], suffix_order._Range.piece, 0
    monkeypatch.setattr(suffix_order._Range, "piece", lambda self, *a: read.append(1) or piece(self, *a))
    for r in each.collect():
        own = suffix_order._Range(suffix_order._Shards(folder), [p.asDict() for p in r["places"]])
        order = own.ranked()
        n += len(order)
        keys = [(texts[u - 1][o:].encode(), u) for u, o in zip(own.uid[order].tolist(), (own.at[order] - own.begin[order]).tolist())]
        assert keys == sorted(keys)
    assert n == sum(map(len, texts)) and len(read) < n / 10


def test_suffix_order_takes_few_bytes_of_disk(spark):
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("aeinorst"), 5)) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary, 500)) for _ in range(200)]
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "uid long, text string").repartition(2)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    assert suffix_order.rank_corpus(corpus).count() == suffix_order.lcp_corpus(corpus).count() == sum(len(t) for t in texts)
    assert size() - before < 6 * sum(len(t) for t in texts)  # of both


def test_first_suffixes_of_a_long_body_take_bounded_bytes():
    body = ("no two are alike in this, but all begin so, for more bytes than are compared at first: " * 2 + "z").encode() * 2000
    at = np.array([m.start() for m in re.finditer(b"no two", body)][:400], np.int64)
    tracemalloc.start()
    got = search.first_suffixes(body, at, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == sorted(at.tolist(), key=lambda p: body[p:])[:64]
    assert peak < 100 << 20  # 133 MB where each suffix is a copy


def test_kwic_top_over_lists_that_are_handed_on(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["the", "aa", "onon", "quick"], 40_000)) for _ in range(3)] + ["the aa", "aa", None, "quick the"]
    corpus = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "uid long, text string").coalesce(1)
    asked = ["the", "aa", "onon the", "quick"]
    got = search.kwic_top(corpus, spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), hits=30).collect()
    for i, q in enumerate(asked):
        every = []
        for u, t in enumerate(texts):
            flat = (t or "").encode() + (b"\xff\xff" + (u + 2).to_bytes(4, "little") if u + 1 < len(texts) else b"")
            every += [(flat[m.start() : m.start() + 400], u + 1, m.start()) for m in re.finditer(f"(?={q})".encode(), (t or "").encode())]
        assert [(r.uid, r.pos) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.k)] == [x[1:] for x in sorted(every)[:30]]
