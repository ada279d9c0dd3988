import hashlib
import re
import zlib
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quarry.llm import byte_bpe, components, exact_dedup, fingerprints, language_model, near_duplicates, packing, pii, pii_field, quality, token_files, toxicity
from quarry.llm.common import fresh_path
from quarry.llm.piece_cache import PieceEncoder
from quarry.llm.textkernel import chunks

LONG = " ".join(f"w{i * i % 977}" for i in range(30_000))
TEXTS = [None, "", "a", "A b c d e f g h", "a b c d e f g h", "a b c d e f g h i", "mail x.y@mail.example.com now", LONG, LONG + " tail", "It's  two\n\nlines, isn't it? 　end ***", "It's  two\n\nlines, isn't it? 　end ***", "\t \n"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + ([(None, "a", "x", 2)] if texts is TEXTS else []), "doc_id long, text string, bucket string, key int")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


def rows(df):
    return [r.asDict() for r in df.collect()]


#: Each operator on a table, by the number that its query has.
EVERY = {
    1: lambda spark, t, labels: quality.classify(t, quality.fit(t, labels), 0.3),
    2: lambda spark, t, labels: language_model.score_documents(t),
    3: lambda spark, t, labels: exact_dedup.exact_duplicates(t),
    4: lambda spark, t, labels: packing.pack_documents(t, public_tokenizers.path("byte_bpe_50k.json")),
    5: lambda spark, t, labels: toxicity.classify(t, toxicity.fit(t, labels)),
    6: lambda spark, t, labels: token_files.read_token_files(spark, *_written(spark, t)),
    7: lambda spark, t, labels: byte_bpe.encode_digests(t, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    8: lambda spark, t, labels: near_duplicates.similar_components(t),
    9: lambda spark, t, labels: pii.detect(t),
    10: lambda spark, t, labels: fingerprints.fingerprints(t),
}


def _written(spark, table):
    folder = fresh_path(spark, "every")
    return folder, token_files.write_token_files(table, folder, public_tokenizers.path("word_bpe_49k.json"), 1, drops_space=True, width=64, shards=2)


@pytest.mark.parametrize("number", EVERY)
def test_empty_tables_repeated_rows_and_clashing_names(spark, number):
    """No rows of no rows; a row for each row (or piece) where ids and rows repeat, beside columns named like the operators' own."""
    shape = "doc_id long, text string, h long, key string, n int, bucket int, c long, part int"
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], shape)
    assert EVERY[number](spark, empty, labels.limit(0)).count() == 0
    made = [(i % 4, t, 1, "k", 2, 3, 4, 5) for i, t in enumerate(["a b c d e f", "a b c d e f", None, "", "x", "a b c d e f", "A b  c", "a b c d e f"])]
    got = rows(EVERY[number](spark, spark.createDataFrame([*made, made[0], (None, "a b c d e f", 1, None, None, None, None, None)], shape), labels))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i in [*(m[0] for m in made), 0, None])


def test_tables_left_behind_can_be_deleted(spark):
    from quarry.llm import common

    kept = common.cut(spark.range(3))
    assert kept.count() == 3 and common.release_all(spark) >= 1 and common.release_all(spark) == 0


def test_exact_duplicates_of_all_bucket_counts(spark, docs):
    for buckets in (1, 5):
        got = {r["doc_id"]: r for r in rows(exact_dedup.exact_duplicates(docs, buckets=buckets)) if r["doc_id"] is not None}
        for i, t in enumerate(TEXTS):
            same = [j for j, u in enumerate(TEXTS) if (u or "") == (t or "")]
            extra = (t or "") == "a"
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same) + extra, i == max(same))
            assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    hot = frame(spark, ["same"] * 500 + [f"t{i}" for i in range(100)])
    assert exact_dedup.drop_exact_duplicates(hot).count() == 101
    odd = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (None, "c", "z"), (None, "c", "z"), (3, None, "w"), (2, "", "v")], "doc_id long, text string, key string")
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0, r["text"] or "", r["key"]) for r in rows(kept)) == [(0, "c", "z"), (1, "a", "x"), (1, "b", "y"), (3, "", "w")]
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_exact_duplicates_of_a_hot_text_among_like_openings(spark):
    texts = [t for i in range(300) for t in ("common opening m", f"common opening a{i}", f"common opening z{i}")]
    for keep, pick in (("max", max), ("min", min)):
        got = rows(exact_dedup.exact_duplicates(frame(spark, texts), keep=keep, buckets=40))
        hot = [r for r in got if texts[r["doc_id"]] == texts[0]]
        assert len(got) == 900 and {(r["keep_id"], r["group_size"]) for r in hot} == {(pick(range(0, 900, 3)), 300)}
        assert sum(r["kept"] for r in got) == 601


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_give_the_library_ids(name, drops):
    enc = PieceEncoder(public_tokenizers.path(name), drops)
    for _ in range(2):  # the second time from the table
        for c in chunks(pa.array(TEXTS), lower=drops):
            ids, bounds = enc.encode(c)
            for i in range(c.rows):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == enc.tokenizer.encode(TEXTS[c.lo + i] or "", add_special_tokens=False).ids


def test_packing_holds_every_capacity(spark, docs):
    counts = {1500: 7, 700: 9, 548: 3, 100: 40, 3: 200, 2048: 2}
    for score in ("norm", "dot"):
        for cap in (packing.Capacity(), packing.Capacity(2048, 4, 5_000_000), packing.Capacity(2048, None, 4_200_000)):
            plan = packing.vector_best_fit(counts, cap, score)
            tokens, n, cost = (np.zeros(plan.sequences, np.int64) for _ in range(3))
            placed = 0
            for length, s, bins, each in zip(plan.length, plan.sequence, plan.bins, plan.each):
                at = np.arange(s, s + bins)
                tokens[at] += each * length
                n[at] += each
                cost[at] += each * length * length
                placed += bins * each
            assert placed == sum(counts.values()) and tokens.max() <= 2048
            assert n.max() <= (cap.documents or 2048) and cost.max() <= (cap.attention or 2048**2)
    got = pd.DataFrame(rows(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))).sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048


def test_packing_query_against_the_library(spark, tmp_path):
    """Every column of the query: pieces, starts, lengths, checksums, and sequences without gaps, nearly as few as the tokens ask."""
    rng = np.random.default_rng(11)
    texts = [*TEXTS, *(" ".join(f"w{x}" for x in rng.integers(0, 900, int(rng.integers(1, 1500)))) for _ in range(60)), *(["tiny"] * 300), "same", "same"]
    table = pa.table({"doc_id": pa.array([*range(len(texts) - 1), len(texts) - 2]), "text": pa.array(texts), "n_chars": pa.array([len(t or "") for t in texts])})
    pq.write_table(table, tmp_path / "documents.parquet")
    got = pd.DataFrame(rows(packing.op4_best_fit_packing(spark, str(tmp_path))))
    enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in zip(table["doc_id"].to_pylist(), texts):
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, p, a, b - a, zlib.crc32(ids[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    sizes = got.groupby("sequence_id").length.agg(["sum", "count"])
    room = []  # plain best fit of falling lengths, one at a time
    for n in sorted(got.length, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 2048) - n)
    assert sizes["sum"].max() <= 2048 and len(sizes) <= len(room) and sizes["count"].max() <= packing.DOCUMENTS


def test_packing_takes_the_fewest_sequences():
    tight, loose = packing.Capacity(2048, 4, 2048**2), packing.Capacity(2048, None, 2048**2)
    assert packing.fewest({1: 4096}, (tight, loose)).sequences == 2 and packing.fewest({512: 8}, (tight, loose)).sequences == 2
    assert packing.fewest({1: 4096}, (tight,)).sequences == 1024 and packing.fewest({}, (tight,)).sequences == 0
    narrow = packing.Capacity(2048, None, 2_000_000)  # attention binds before tokens do
    assert packing.fewest({1000: 6}, (narrow,)).sequences == 3 and packing.fewest({1000: 6}, (packing.Capacity(2048, None, 1_500_000),)).sequences == 6


def test_token_files_round_trip(spark, docs):
    folder, path = fresh_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_token_files(docs, folder, path, 1, drops_space=True, width=64, shards=3)
    got = sorted(rows(token_files.read_token_files(spark, folder, manifest)), key=lambda r: r["start"])
    enc, at = PieceEncoder(path, True), 0
    for r in got:
        text = "a" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = np.array([*enc.tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids))
        assert token_files.TokenFiles(folder).tokens(at, len(ids)).tolist() == ids.tolist()
        at += len(ids)
    assert manifest["n_tokens"] == at


def test_byte_bpe_cuts_are_safe(spark, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for t in TEXTS:
        whole = byte_bpe.encoding(path).encode_ordinary(t or "")
        assert byte_bpe.encode(t or "", path, 7).tolist() == whole
        assert byte_bpe.decode(np.array(whole, "<u4"), path) == (t or "").encode()
    assert byte_bpe.encode_digests(docs, path).count() == len(TEXTS) + 1


def _sets(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    return out


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = [[f"v{x}" for x in rng.integers(0, 400, 60)] for _ in range(6)]
    texts = list(TEXTS)
    for i in range(60):
        w = list(base[i % 6])
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(60))] = f"n{rng.integers(9)}"
        texts.append(" ".join(w))
    sets = _sets(texts)
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: r for r in rows(near_duplicates.similar_components(frame(spark, texts)))}
    assert {i: got[i]["component_id"] for i in got} == dict(enumerate(root))
    assert all(got[i]["n_shingles"] == len(s) for i, s in enumerate(sets))


def _brute_components(texts):
    sets, root = _sets(texts), list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [4, 1024])
def test_near_duplicates_under_hot_keys(spark, monkeypatch, block):
    """A passage that all share, sizes on both sides of the limit, and families that link only through some members."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "ORDER_LEAST", 10**9 if block == 4 else 4)  # no shingle counts as frequent
    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for i in range(120):
        own = [f"o{x}" for x in rng.integers(0, 30, int(rng.integers(0, 25)))]
        texts.append(" ".join(passage[: int(rng.integers(15, 41))] + own))
    got = {r["doc_id"]: r["component_id"] for r in rows(near_duplicates.similar_components(frame(spark, texts)))}
    assert [got[i] for i in range(len(texts))] == _brute_components(texts)


def test_near_duplicates_drop_no_other_text_of_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    table = spark.createDataFrame([(1, a), (5, a + " x"), (5, b), (5, b + " y"), (None, a), (7, None), (7, "")], "doc_id long, text string")
    left = sorted((r["doc_id"], r["text"] or "") for r in rows(near_duplicates.drop_near_duplicates(table)) if r["doc_id"])
    assert (1, a) in left and (5, a + " x") not in left and len([x for x in left if x[0] == 5]) == 1 and left[-2:] == [(7, ""), (7, "")]
    assert near_duplicates.drop_near_duplicates(table).where("doc_id IS NULL").count() == 1
    assert near_duplicates.similar_components(frame(spark, [])).count() == 0


def test_components_are_whole_or_an_error(spark):
    path = spark.createDataFrame([((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)], "a long, b long")
    assert {r["root"] for r in rows(components.components(path))} == {0}
    with pytest.raises(RuntimeError):
        components.components(path, most=1)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    points = rng.poisson(0.4, (150, near_duplicates.GROUPS))
    points[75:] = np.maximum(points[:75] + rng.integers(-1, 2, (75, near_duplicates.GROUPS)) * (rng.random((75, near_duplicates.GROUPS)) < 0.1), 0)
    n = points.sum(axis=1)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if 175 * np.minimum(points[i], points[j]).sum() >= 75 * (n[i] + n[j])}
    a, b = near_duplicates.RTree(points, n).pairs(75)
    assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())} == want


def test_personal_data_base_spans_and_field(spark, docs):
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    checks = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m)), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("ab1234567890.@-+ ()_"), 80)) for _ in range(400)] + ["4111 1111 1111 1111 x", "a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8", "999.1.2.3.4", "1.2.3.00000000000000000000999 1.2.3.00000000000000000000099", "1.2.3.99999999999999999999"]
    for t in made:
        want = sorted((m.start(), k, m.end()) for k, (name, p) in enumerate(patterns) for m in re.finditer(p, t) if checks[name](m[0]))
        assert [(a, pii.KINDS.index(k), b) for a, b, k in pii.base_spans(t)] == want
    for text, kind, what in FOUND_BY_THE_FIELD:
        base, found = pii.find_spans([text])[0]
        assert not base and [(k, text[a:b]) for a, b, k in found] == [(kind, what)]
    for text in LEFT_BY_THE_FIELD:
        assert pii.find_spans([text]) == [([], [])]
    assert "x.y@" not in [r["text"] for r in rows(pii.redact(docs)) if r["doc_id"] == 6][0]


FOUND_BY_THE_FIELD = [
    ("please call (415) 555-0134 today or not", "phone", "(415) 555-0134"),
    ("write to anna(at)example.com, thanks", "email", "anna(at)example.com"),
    ("reach Peter [at] mail [dot] org please", "email", "Peter [at] mail [dot] org"),
    ("naïve token = \"3f9ac1d07be2465899ab01cd23ef45678890abcd\" over", "secret", "3f9ac1d07be2465899ab01cd23ef45678890abcd"),
    ("fax 040/7654321 today", "phone", "040/7654321"),
    ("from 192.168.17[.]203 again", "ip", "192.168.17[.]203"),
]
LEFT_BY_THE_FIELD = ["In 1999 the 16 items cost 12.50 of 120.", "Licensed under CC BY-NC 4.0.", "see me at the house at noon", "chapter 3.1.4, pages 17-203", "word " * 3000]


def test_field_decodes_whole_chains_exactly():
    field, rng = pii_field.trained_field(), np.random.default_rng(5)
    for _ in range(40):
        size = rng.integers(1, 9, 6)
        bounds = np.concatenate([[0], np.cumsum(size)])
        scores = rng.normal(0, 3, (bounds[-1], len(pii_field.TAGS)))
        scores[:, 0] += rng.choice([0, 12], len(scores))
        got = field.decode(scores, bounds)
        for a, b in zip(bounds, bounds[1:]):
            assert (got[a:b] == field.viterbi(scores[a:b][None])[0]).all()


def test_field_on_templates_it_has_not_seen(monkeypatch):
    """Precision and recall by span on sentences from other random numbers than those it learned from."""
    made, real = [], np.random.default_rng
    field = pii_field.trained_field()
    monkeypatch.setattr(pii_field.np.random, "default_rng", lambda seed: real(1234))
    made = pii_field.labelled_table()
    right = found = wanted = 0
    for words_, tags in made:
        text, want, at, before = " ".join(words_), [], 0, 0
        for w, t in zip(words_, tags):
            if t:
                want = [*want[:-1], (t, want[-1][1], at + len(w))] if t == before else [*want, (t, at, at + len(w))]
            at, before = at + len(w) + 1, t
        got = {(pii_field.TAGS.index(k), text[a:b]) for c in chunks(pa.array([text])) for _, a, b, k in field.spans(c)}
        want = {(t, text[a:b]) for t, a, b in want}
        right, found, wanted = right + len(got & want), found + len(got), wanted + len(want)
    assert right / found > 0.95 and right / wanted > 0.9


def test_fingerprints(spark, docs):
    got = {r["doc_id"]: r for r in rows(fingerprints.fingerprints(docs))}
    order = [i for i in reversed(range(len(TEXTS)))] + [None]
    text = lambda i: "a" if i is None else TEXTS[i] or ""
    for i, j in zip(order, order[1:] + order[:1]):
        own = text(i)
        cut = len(own) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((own[: len(own) - cut] + text(j)[:cut]).encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and got[i]["n_chars"] == len(own)
    assert got[9]["fingerprint"] == got[10]["fingerprint"] and got[7]["near_edited"] > 0.5


def test_syncmers_by_their_definition():
    """Every k-mer whose smallest inner s-mer is its first or last, ties included; the same rule for all lengths."""
    rng = np.random.default_rng(4)
    for n in [*range(0, 40), 63, 64, 65, 300]:
        code = rng.integers(97, 100 if n % 2 else 120, n).astype(np.uint64)
        h, place = fingerprints.fingerprint(code)
        inner = fingerprints._window_hashes(code, fingerprints.S).tolist() if n >= fingerprints.K else []
        want = []
        for i in range(n - fingerprints.K + 1):
            own = inner[i : i + fingerprints.K - fingerprints.S + 1]
            if min(own) in (own[0], own[-1]):
                want.append(i)
        assert place.tolist() == (want or [0] * min(n, 1))
        same = {}
        for i, x in zip(place.tolist(), h.tolist()):  # equal k-mers have equal hashes, others don't
            assert same.setdefault(tuple(code[i : i + fingerprints.K] if want else code), x) == x
        assert len(set(same.values())) == len(same)
    base = rng.integers(97, 123, 64).astype(np.uint64)
    assert fingerprints.likeness(fingerprints.fingerprint(base[:63]), fingerprints.fingerprint(base)) > 0.9


@pytest.mark.parametrize("bucket_bytes", [200, 1 << 20])
def test_fingerprints_of_repeated_and_odd_ids(spark, bucket_bytes):
    rng = np.random.default_rng(8)
    made = [(int(rng.integers(-5, 5)) if i % 3 else 7, " ".join(f"w{x}" for x in rng.integers(0, 50, 12))) for i in range(90)] + [(None, "x"), (None, None), (2**62, "top"), (-(2**62), "")]
    got = rows(fingerprints.fingerprints(spark.createDataFrame(made, "doc_id long, text string"), bucket_bytes=bucket_bytes))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t in made)
    # each edited text ends in the start of a row that the order allows next
    ids = sorted({i for i, _ in made if i is not None}, reverse=True) + [None]
    by_id = {i: [t or "" for j, t in made if j == i] for i in ids}
    for r in got:
        following = by_id[r["doc_id"]] + by_id[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        own = [t for t in by_id[r["doc_id"]] if len(t) == r["n_chars"]]
        assert r["edited_sha256"] in {hashlib.sha256(fingerprints.edited(t, f).encode()).hexdigest() for t in own for f in following}
    assert rows(fingerprints.fingerprints(frame(spark, []))) == []
    one = rows(fingerprints.fingerprints(frame(spark, ["only this text, its own next one"])))
    assert one[0]["near_next"] == 1.0


def _print_of(words):
    return fingerprints.fingerprint(fingerprints.codes(" ".join(words)))


def test_fingerprints_keep_all_anchors_of_long_texts():
    rng = np.random.default_rng(6)
    a, b, shared = ([f"q{x}" for x in rng.integers(0, 100_000, n)] for n in (19_800, 19_800, 200))
    one, two = _print_of(a[:9000] + shared + a[9000:]), _print_of(b[:3000] + shared + b[3000:])
    assert fingerprints.likeness(one, two) > 0.005 and fingerprints.likeness(_print_of(a), _print_of(b)) < 0.005
    assert len(one[0]) > len(" ".join(a)) / 5 and set(_print_of(a)[0]) != set(_print_of(a[:700] + ["edit"] + a[701:])[0])
    text = fingerprints.render(one)
    assert text == " ".join(f"{h:08x}.{p:x}" for h, p in zip(*one)) and all((x == y).all() for x, y in zip(one, fingerprints.parse(text)))


def test_insertions_cost_the_anchors_they_touch():
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 5000, 1500)]
    for n, least in ((1, 0.99), (10, 0.97), (30, 0.93)):
        longer = list(base)
        for i in rng.integers(0, 1500, n):
            longer.insert(i, "inserted")
        assert fingerprints.likeness(_print_of(base), _print_of(longer)) > least
    for limit in (0, 4, 1000):  # both methods, against the table of all places
        for _ in range(60):
            a, b = (rng.integers(0, int(rng.integers(1, 30)), int(rng.integers(0, 30))).astype(np.uint32) for _ in range(2))
            row = [0] * (len(b) + 1)
            for x in a:
                new = [0]
                for j, y in enumerate(b):
                    new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
                row = new
            assert fingerprints.chained(a, b, limit) == row[-1]


def test_language_model_base_and_null_rows(spark, docs):
    got = {r["doc_id"]: r for r in rows(language_model.score_documents(docs))}
    assert got[0]["n_tokens"] == got[1]["n_tokens"] == 1 and got[None]["held_out"] is None
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "\n"] for i, t in enumerate(TEXTS)}
    counts = {}
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        want = sum(np.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert got[i]["train_tokens"] == n and abs(got[i]["base_score"] - want) < 1e-6 * max(1, abs(want)) and got[i]["score"] < 0


def _seatings(c):
    """Weights of all seatings of c customers by number of tables, one customer after the other."""

    def go(tables, left, weight, out):
        if not left:
            out[len(tables)] = out.get(len(tables), 0) + weight
            return
        go([*tables, 1], left - 1, weight, out)
        for i, n in enumerate(tables):
            go([*tables[:i], n + 1, *tables[i + 1 :]], left - 1, weight * (n - 0.7), out)

    out = {}
    go([1], c - 1, 1.0, out)
    return out


def test_seats_follow_the_restaurant():
    numbers = language_model.stirling(0.7)
    for c in range(1, 8):
        assert np.allclose([np.exp(numbers[c, t]) for t in range(1, c + 1)], [_seatings(c)[t] for t in range(1, c + 1)])
    rng = np.random.default_rng(0)
    got = language_model.seat(np.full(40_000, 6), np.full(40_000, 1.3), 0.7, numbers, rng)
    want = np.array([np.exp(numbers[6, t]) * 1.3**t for t in range(1, 7)])
    assert np.abs(np.bincount(got, minlength=7)[1:] / 40_000 - want / want.sum()).max() < 0.01
    for weight in (0.5, 30.0, 200.0):  # the limit meets the exact numbers
        t = np.arange(1, 257)
        p = np.exp(numbers[256, 1:] + t * np.log(weight) - (numbers[256, 1:] + t * np.log(weight)).max())
        assert abs(language_model.mean_tables(np.array([256]), np.array([weight]), 0.7)[0] - (p * t).sum() / p.sum()) < 0.03 * (p * t).sum() / p.sum()
    assert np.allclose(language_model.log_gamma(np.array([0.3, 1.0, 5.0, 100.0])), [1.0957979948180756, 0.0, np.log(24), 359.1342053695754])


def test_gibbs_reaches_the_posterior_of_all_seatings():
    """A restaurant of three dishes: tables of the chain against the sum over all numbers of tables."""
    numbers, d, strength = language_model.stirling(0.7), 0.7, 1.0
    customers, measure = np.array([5, 3, 2]), np.array([0.2, 0.5, 0.3])
    total, mean = 0.0, np.zeros(3)
    for t in np.ndindex(5, 3, 2):
        t = np.array(t) + 1
        weight = np.prod([strength + d * i for i in range(t.sum())]) * np.prod([np.exp(numbers[c, k]) * m**k for c, k, m in zip(customers, t, measure)])
        total, mean = total + weight, mean + weight * t
    rng, t, seen = np.random.default_rng(1), np.ones(3), np.zeros(3)
    for sweep in range(30_000):
        x = rng.gamma(strength / d + t.sum())
        t = language_model.seat(customers, d * x * measure, d, numbers, rng)
        seen += t
    assert np.abs(seen / 30_000 - mean / total).max() < 0.03


def test_burn_in_lasts_until_the_tables_have_settled(spark, monkeypatch):
    """The share that contexts hand to their parent, against a long burn-in."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 150) if x < 3000) for _ in range(400)]
    docs = frame(spark, texts).select("text")
    got = language_model.train(docs)[0]
    monkeypatch.setattr(language_model, "BURN_IN", 20)
    want = language_model.train(docs)[0]
    often = want.classes[want.counts > 50]
    assert len(often) > 30 and abs(got.back[often].mean() / want.back[often].mean() - 1) < 0.03


def test_probabilities_of_every_restaurant_sum_to_one(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 60) if x < 60) for _ in range(80)] + [None, ""]
    model, table = language_model.train(frame(spark, texts).select("text"), classes=20, head=30, pairs=50)
    gains = {r["k"]: r["value"] for r in table.where("kind = 2").collect()}
    side, step = model.side, language_model.STEP
    dishes = np.arange(side - 1)
    twos = sorted({k % step for k in gains if k % step})
    assert twos and abs(model.root[:-1].sum() - 1) < 1e-9

    def one(u):
        p = model.backoff(u * side + dishes, np.zeros(len(dishes), np.int64))
        return p * 10.0 ** np.array([gains.get((u * side + int(w)) * step, 0.0) for w in dishes])

    for u in range(side):
        assert abs(one(u).sum() - 1) < 1e-6
    for two in twos:
        u = (two - 1) % language_model.CONTEXT_WORDS + 1
        p = model.back_two[two] * one(u) * 10.0 ** np.array([gains.get((u * side + int(w)) * step + two, 0.0) for w in dishes])
        assert abs(p.sum() - 1) < 1e-6
    rare = np.array([r["value"] for r in table.where("kind = 1").collect() if int(np.int64(r["k"]).astype(np.uint64)) not in set(model.words[model.classes > 0].tolist())])
    assert abs(model.rare(np.append(rare, 0)).sum() - 1) < 1e-6


def test_every_word_and_context_has_its_restaurant(spark):
    """Scores against a plain computation, with words beyond the head; probabilities after any two words sum to one."""
    rng, side_by = np.random.default_rng(3), language_model.CONTEXT_WORDS
    texts = [" ".join(f"w{int(x)}" for x in [*rng.zipf(1.3, 30), *rng.integers(200, 400, 10)] if x < 400) for _ in range(60)] + ["x1 y1", "x2 y2"] * 4 + ["x1 y1", "x1 y2", "x1 unseen", None, ""]
    learn = [i < 60 + 4 for i in range(len(texts))]
    docs = spark.createDataFrame([(i + 7, i, t, on) for i, (t, on) in enumerate(zip(texts, learn))], "rid long, doc_id long, text string, learn boolean")
    m, table = language_model.train(docs.where("learn").select("text"), classes=270, head=300, pairs=200)
    gains = {r["k"]: r["value"] for r in table.where("kind = 2").collect()}
    got = {r["doc_id"]: r for r in rows(language_model.score(docs, m, table))}
    split = lambda t: ["<s>", "<s>", *(t or "").split(), "</s>"]
    grams = [[tuple(s[i : i + 3]) for i in range(len(s) - 2)] for s in map(split, texts)]
    counts, words = {}, {}
    for on, g in zip(learn, grams):
        for x in g if on else []:
            counts[x] = counts.get(x, 0) + 1
            words[x[2]] = words.get(x[2], 0) + 1
    raw = [*words, "unseen"]
    buf = list(chunks(pa.array([w for w in raw if w != "</s>"])))[0]
    h = dict(zip([w for w in raw if w != "</s>"], language_model.span_hashes(buf.buf, *language_model.words(buf)[:2])))
    h["</s>"] = language_model.END
    kind = {w: int(m.look_up(np.array([x], np.uint64))[1][0]) for w, x in h.items()} | {"<s>": m.side - 1}
    two_of = lambda a, b: (kind[a] - 1) * side_by + kind[b] if 0 < kind[a] <= side_by and 0 < kind[b] <= side_by else 0
    tail = {x: n for x, n in counts.items() if not (kind[x[1]] and kind[x[2]])}
    one = {}
    for a, b, w in tail:
        one[b, w] = one.get((b, w), 0) + 1
    followers, rarer = {}, {}
    for (a, b, w), n in counts.items():
        followers.setdefault((a, b), []).append((w, n))
    for (b, _), n in one.items():
        rarer.setdefault(b, []).append(n)
    fit = lambda v: min(max((v.count(1) + 0.5) / (v.count(1) + 2 * v.count(2) + 1), 0.05), 0.95)
    d1, d2 = fit([n for (b, _), n in one.items() if kind[b]]), fit([n for (_, b, _), n in tail.items() if kind[b]])

    def seat(c, d, of, over):
        return (max(c - d, 0) + (1 + d * len(of)) * over) / (1 + sum(of))

    def p(a, b, w):
        u, two, rare = kind[b], two_of(a, b), float(m.rare(np.array([words.get(w, 0)]))[0]) if not kind[w] else 1.0
        k = u * m.side + kind[w]
        head = float(m.back[u] * m.root[kind[w]]) * 10 ** gains.get(k * language_model.STEP, 0.0)
        if two:
            outer = float(m.back_two[two]) * head * 10 ** gains.get(k * language_model.STEP + two, 0.0)
            if kind[w]:
                return outer
        if u and kind[w]:
            level = head
        else:
            level = seat(one.get((b, w), 0), d1, rarer.get(b, []), rare if u else head * rare)
            level *= head if u and not two else 1.0
        after = [n for z, n in followers.get((a, b), []) if not (two and kind[z])]
        return seat(counts.get((a, b, w), 0), d2, after, level) * (outer if two else 1.0)

    for a, b in {(g[0], g[1]) for x in grams[:6] + grams[-5:] for g in x} | {("w1", "w1"), ("w39", "unseen")}:
        kind.setdefault(a, 0)
        assert abs(sum(p(a, b, w) for w in raw) - 1) < 1e-6
    kinds_of = {(bool(two_of(a, b)), kind[b] > 0, kind[w] > 0) for a, b, w in counts}
    assert len(kinds_of) == 6  # every way of the model
    for i, g in enumerate(grams):
        want = sum(np.log10(p(*x)) for x in g)
        assert abs(got[i]["score"] - want) < 1e-5 * max(1, abs(want)), (texts[i], got[i]["score"], want)
    n = len(texts)
    assert got[n - 5]["score"] > got[n - 4]["score"] + 0.1  # rare words after a rare one


def test_parts_grow_with_tokens_not_with_partitions():
    assert language_model.parts_for(27_000_000, 211) == language_model.parts_for(27_000_000, 1000) < 32
    assert language_model.parts_for(135_000_000, 51) == 102 and language_model.parts_for(8 << 30, 200) == 1024


def test_packed_rows_are_written_and_sent_in_bounded_pieces(spark):
    """Rows of 1 MB of a task: no row group nor batch holds them all."""
    random = lambda batches: (pa.RecordBatch.from_pydict({"data": [np.random.default_rng(i).bytes(1 << 20)]}) for b in batches for i in b.column("id").to_pylist())
    table = language_model.cut(spark.range(0, 48, 1, 1).mapInArrow(random, "data binary"))
    groups = [g for x in table.inputFiles() for m in [pq.read_metadata(urlparse(x).path)] for g in (m.row_group(i).total_byte_size for i in range(m.num_row_groups))]
    sizes = language_model.cut(table.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes], "rows": [b.num_rows]}) for b in batches), "n long, rows long")).collect()
    assert sum(groups) >= 48 << 20 and max(groups) < 24 << 20
    assert sum(r["rows"] for r in sizes) == 48 and max(r["n"] for r in sizes) < 12 << 20


def test_language_model_of_repeated_ids_and_no_rows(spark):
    table = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "x"), (2, "a b a b a b")], "doc_id long, text string")
    got = rows(language_model.score_documents(table))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(1, 2), (1, 4), (1, 4), (2, 7)] and all(r["score"] < 0 for r in got)
    assert rows(language_model.score_documents(frame(spark, []))) == []


def test_classifiers_learn_and_take_odd_rows(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"word{x}" for x in rng.integers(0, 50, 40)) + (" zzbad qqbad" if i % 4 == 0 else "") for i in range(200)] + [None, ""]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = rows(module.classify(docs, module.fit(docs, labels), 0.5))
        assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    right = [r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["doc_id"] < 200]
    assert np.mean(right) > 0.95
    empty = labels.limit(0)
    assert toxicity.classify(docs, toxicity.fit(docs, empty)).count() == len(texts)


def test_quality_votes_against_all_cosines(spark):
    """Terms counted one by one, all cosines in one product, ties among the nearest included."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"word{x}" for x in rng.integers(0, 60, 30)) if i % 3 else " ".join([f"w{i % 7}"] * 30) + "\nX\nX" for i in range(90)] + [None, "", "ab"]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)] + [(4, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)

    def vector(text):
        raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
        own = np.zeros(quality.TERMS)
        for i in range(len(raw) - 2):
            h = (int(raw[i]) * 0x9E3779B1 + int(raw[i + 1]) * 0x85EBCA77 + int(raw[i + 2]) * 0xC2B2AE3D) % 2**32
            own[(((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32) >> 21] += 1
        own = np.log1p(own)
        w, lines = (text or "").split(), (text or "").split("\n")
        for j, k in enumerate(quality.LAGS):
            own[quality.FEATURES + j] = sum(a == b for a, b in zip(w, w[k:]))
        own[-1] = sum(a == b and a != "" for a, b in zip(lines, lines[1:]))
        own *= model.idf
        v = own / max(np.linalg.norm(own), 1e-9) @ model.project
        return v / np.linalg.norm(v) if np.linalg.norm(v) else v

    for r in rows(quality.classify(docs, model, 0.3)):
        cos = model.vectors.astype(float) @ vector(texts[r["doc_id"]])
        best = np.argsort(-cos, kind="stable")[: quality.NEIGHBOURS]
        w = np.clip(cos[best], 0, 1) ** quality.SHARPNESS
        want = ((w * model.labels[best]).sum() + quality.PRIOR_WEIGHT * model.prior) / (w.sum() + quality.PRIOR_WEIGHT)
        assert abs(r["score"] - want) < 0.02 and r["predicted"] == int(r["score"] >= 0.3)
    assert quality.classify(frame(spark, []), model, 0.3).count() == 0


def test_toxicity_learns_from_texts_with_a_common_frame(spark):
    rng = np.random.default_rng(8)
    head, tail = "the common header of a hot source " * 4, " and its common footer, the same everywhere" * 3
    texts = [head + " ".join(f"word{x}" for x in rng.integers(0, 50, 40)) + (" zzbad qqbad" if i % 4 == 0 else "") + tail for i in range(200)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = rows(toxicity.classify(docs, toxicity.fit(docs, labels)))
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got)


def test_block_max_index_is_exact(monkeypatch):
    """Against all products, with long and short lists and pruned blocks; ties by the number of the example."""
    rng = np.random.default_rng(4)
    v = rng.random((500, 60)) * (rng.random((500, 60)) < np.linspace(0.02, 0.6, 60))
    v[:, 0] += 0.01
    v[100:120] = v[99]
    v[250:] *= np.arange(60) < 30  # half of them have nothing of the other lists
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    example, feature = np.nonzero(v)
    q = v[90:130]
    row, asked = np.nonzero(q)
    for long in (1, 5, 1000):
        monkeypatch.setattr(toxicity, "LONG", long)
        index = toxicity.BlockMaxIndex(feature, example, v[example, feature], 60, 500, 16)
        for (at, cos), x in zip(index.nearest(row, asked, q[row, asked], 40, 10), q):
            every = v @ x
            assert np.allclose(cos, np.sort(every)[::-1][:10], atol=1e-5) and np.allclose(every[at], cos, atol=1e-5)
    at = toxicity.BlockMaxIndex(feature, example, v[example, feature], 60, 500, 16).nearest(*np.nonzero(v[99:100]), v[99][v[99] > 0], 1, 10)[0][0]
    assert at.tolist() == list(range(99, 109))


def test_toxicity_votes_against_all_products(spark):
    """Scores of the query from dense vectors of all features, worked out one text at a time."""
    rng = np.random.default_rng(12)
    texts = [" ".join(f"{'zz' if x < 3 and i % 3 == 0 else 'w'}ord{x}" for x in rng.integers(0, 40, 25)) for i in range(60)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)

    def counted(text):
        q = toxicity.Counted.of(next(iter(chunks(pa.array([text]), lower=True))))
        return dict(zip(q.hashes.tolist(), q.counts.tolist()))

    kept = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    vectors, y = {i: counted(texts[i]) for i in kept}, {i: float(i % 3 == 0) for i in kept}
    names = {h for v in vectors.values() for h in v}
    weight = {}
    for h in names:
        df, a = sum(h in v for v in vectors.values()), sum(y[i] for i, v in vectors.items() if h in v)
        weight[h] = (np.log((1 + len(kept)) / (1 + df)) + 0.01) * np.log2(2 + a / max(df - a, 1))

    def unit(v):
        w = {h: (1 + np.log(n)) * weight.get(h, np.log(1 + len(kept)) + 0.01) for h, n in v.items()}
        norm = np.sqrt(sum(x * x for x in w.values()))
        return {h: x / norm for h, x in w.items()}

    units = {i: unit(v) for i, v in vectors.items()}
    for r in rows(toxicity.classify(docs, model)):
        own = unit(counted(texts[r["doc_id"]]))
        cos = {i: sum(x * own.get(h, 0) for h, x in u.items()) for i, u in units.items()}
        best = sorted(kept, key=lambda i: (-round(cos[i], 6), i))[: toxicity.NEIGHBOURS]
        top = sum(cos[i] ** 2 * y[i] for i in best) + toxicity.SMOOTHING * model.rate
        vote = top / (sum(cos[i] ** 2 for i in best) + toxicity.SMOOTHING)
        assert abs(r["score"] - 1 / (1 + np.exp(-(model.slope * vote + model.shift)))) < 1e-3
        assert abs(cos[r["neighbours"][0]] - cos[best[0]]) < 1e-5 and r["terms"]


def test_votes_are_calibrated():
    rng = np.random.default_rng(3)
    votes = rng.random(20_000)
    labels = (rng.random(20_000) < 1 / (1 + np.exp(-(6 * votes - 2)))).astype(float)
    slope, shift = toxicity._calibration(votes, labels)
    assert abs(slope - 6) < 0.3 and abs(shift + 2) < 0.2
