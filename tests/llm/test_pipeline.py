"""The pipeline over a small table, held against what each stage's definition asks for."""

import re

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import pii

BAD, GOOD = ["vilex", "grunta", "scorv", "blethik"], ["meadow", "harbor", "lantern", "orchard"]
PLAIN = [f"word{i}" for i in range(400)]


def _text(i: int, own: list[str], n: int = 40) -> str:
    return " ".join(own[(i + k) % len(own)] if k % 5 == 0 else PLAIN[(i * 37 + k * (i % 11 + 1)) % 400] for k in range(n))


def _tables():
    docs, labels = [], []
    for i in range(400):  # labelled: every second one is toxic
        docs.append((i, _text(i, BAD if i % 2 else GOOD)))
        labels.append((i, 1 - i % 2, i % 2))
    docs += [(1000, _text(1000, BAD)), (1001, _text(1001, GOOD)), (1002, _text(1001, GOOD))]  # unlabelled: toxic, clean, its copy
    docs += [(1003, _text(1003, GOOD, 100)), (1004, _text(1003, GOOD, 100) + " tail"), (1005, _text(1005, GOOD) + " write to x.y@mail.example.com today")]
    docs += [(1006, None), (1007, ""), (1008, " ".join(PLAIN[k * k % 397] for k in range(5000)))]
    return docs, labels


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    docs, labels = _tables()
    pq.write_table(pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs], "lang": ["en"] * len(docs), "source": ["s"] * len(docs), "n_chars": pa.array([len(t or "") for _, t in docs], pa.int64())}), out / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([d for d, _, _ in labels], pa.int64()), "quality": pa.array([q for _, q, _ in labels], pa.int32()), "toxic": pa.array([t for _, _, t in labels], pa.int32())}), out / "labels.parquet")
    return str(out)


def _shingles(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def _one_of_each_component(texts: dict[int, str | None]) -> set[int]:
    sets = {i: _shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i for i in texts if root(i) == i}


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, given = docs.columns, dict(_tables()[0])

    toxic_gone = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert toxic_gone.columns == columns
    left = {r["doc_id"]: r["text"] for r in toxic_gone.collect()}
    assert 1000 not in left and {1001, 1002, 1003, 1004, 1005, 1008} <= set(left)
    assert all(left[i] == given[i] for i in left) and {i % 2 for i in left if i < 400} == {0}

    once = corpus_pipeline.drop_copies(spark, toxic_gone, folder)
    assert once.columns == columns
    last = {t or "": i for i, t in sorted(left.items())}
    kept = {r["doc_id"]: r["text"] for r in once.collect()}
    assert set(kept) == set(last.values())

    apart = corpus_pipeline.drop_near_copies(spark, once, folder)
    assert apart.columns == columns
    assert {r["doc_id"] for r in apart.collect()} == _one_of_each_component(kept)

    clean = corpus_pipeline.redact_personal_data(spark, apart, folder)
    assert clean.columns == columns
    for r in clean.collect():
        spans = pii.find_spans([kept[r["doc_id"]] or ""])[0][1]
        assert r["text"] == (pii.redact_text(kept[r["doc_id"]], spans) if spans else kept[r["doc_id"]])
        assert r["text"] is None or r["n_chars"] == len(r["text"])
        if r["doc_id"] == 1005:
            assert "<EMAIL>" in r["text"] and "@" not in r["text"]


def test_run_packs_what_the_stages_leave(spark, folder):
    got = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    ids = {r["doc_id"] for r in got}
    assert 1000 not in ids and {1002, 1003, 1005, 1008} <= ids and not {1001, 1004} & ids
    by_sequence: dict[int, list] = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    long = sum(r["length"] for r in got if r["doc_id"] == 1008)
    assert long == len(enc.encode(dict(_tables()[0])[1008], add_special_tokens=False).ids) + 1
