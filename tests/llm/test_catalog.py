"""The registered queries against their SQL, and the pipeline."""

import hashlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from histscore.llm.catalog import llm_oracle, llm_queries
from tests.llm import test_quality, test_simhash, test_substring
from tests.llm.helpers import SF, no_docs, odd_docs, split
from tests.llm.test_mixing import brute_targets
from tests.llm.test_tokens import library
from tools.compare import compare, duck


@pytest.mark.parametrize("name", sorted(llm_oracle()))
def test_matches_oracle(spark, name):
    result = compare(spark, duck(SF), SF, name, llm_queries()[name], llm_oracle()[name])
    assert result["status"] == "OK", result


def test_all_registered():
    names = E.queries()
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


def stages(spark, docs, sf, path):
    out = {}
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(f"{path}/{name}")
        docs = out[name] = spark.read.parquet(f"{path}/{name}")
    return out


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = stages(spark, docs, SF, str(tmp_path))
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in got.items()}
    for name in list(got)[:-1]:
        assert got[name].columns == docs.columns
    assert set(ids["near_dedup"]) < set(ids["quality_rules"])
    assert sorted(ids["substring_dedup"]) == sorted(ids["near_dedup"])
    assert set(ids["mix_sources"]) <= set(ids["substring_dedup"])
    assert set(ids["pack"]) == set(ids["mix_sources"])
    again = {(r.doc_id, r.start, r.ids_crc32) for r in P.run(spark, SF).collect()}
    assert again == {(r.doc_id, r.start, r.ids_crc32) for r in got["pack"].collect()}


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_pipeline_rows_match_brute_force(spark, tmp_path):
    """Every stage's rows, texts included, from the rows before it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {k: rows_of(v) for k, v in stages(spark, docs, SF, str(tmp_path)).items()}

    before = {r["doc_id"]: r for r in rows_of(docs)}
    kept = got["quality_rules"]
    verdicts = {r.doc_id: r.kept for r in E.queries()["op1_quality_rules"](spark, SF).collect()}
    assert {r["doc_id"] for r in kept} == {i for i, k in verdicts.items() if k}
    for r in kept:
        assert r == before[r["doc_id"]]
        n, _, _, _, repeated = test_quality.brute(r["text"])
        assert n >= 50 and 100 * repeated <= 50 * n

    kept.sort(key=lambda r: r["doc_id"])
    roots = test_simhash.brute_groups([test_simhash.brute_fp(r["text"]) for r in kept])
    one_each = [r for k, r in enumerate(kept) if roots[k] == k]
    near = sorted(got["near_dedup"], key=lambda r: r["doc_id"])
    assert near == one_each

    cut = {i: (gone, sha) for i, _, gone, sha in test_substring.brute([(r["doc_id"], r["text"]) for r in near])}
    whole = {r["doc_id"]: r for r in near}
    texts = {r["doc_id"]: r for r in got["substring_dedup"]}
    assert len(texts) == len(got["substring_dedup"]) == len(near)
    for i, r in texts.items():
        gone, sha = cut[i]
        if gone:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == sha and r["n_chars"] == len(r["text"])
        else:
            assert r == whole[i]

    sizes: dict = defaultdict(int)
    for r in texts.values():
        sizes[r["source"]] += len(split(r["text"]))
    targets = brute_targets(sizes)
    copies = Counter(r["doc_id"] for r in got["mix_sources"])
    assert all(r == texts[r["doc_id"]] for r in got["mix_sources"])
    for i, r in texts.items():
        rate = targets[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert int(rate - 1e-9) <= copies[i] <= int(rate + 1e-9) + 1

    encode = library("byte_bpe_50k.json")
    length: Counter = Counter()
    windows = defaultdict(list)
    for p in got["pack"]:
        length[p["doc_id"]] += p["length"]
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    assert length == {i: n * (len(encode(texts[i]["text"])) + 1) for i, n in copies.items()}
    for pieces in windows.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 1024


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    got = stages(spark, odd_docs(spark), SF, str(tmp_path / "odd"))
    assert got["near_dedup"].columns == odd_docs(spark).columns
    assert got["pack"].count() > 0
    got = stages(spark, no_docs(spark), SF, str(tmp_path / "none"))
    assert got["pack"].count() == 0
