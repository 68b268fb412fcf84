"""Source divergence against brute force, and the merge alone."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from histscore.llm import divergence as D
from tests.llm.helpers import no_docs, odd_docs, odd_rows, real_docs


def brute(docs, least=30, top=50):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    rows = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        sources = [s for la, s in groups if la == lang]

        def share(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        of = {s: share(counts[lang, s]) for s in sources}
        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(of[s][t] - of[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(whole[t] - of[s][t], t.encode()) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            for part, some in (("pair", pairs), ("term", sorted(terms)[:top])):
                rows |= {(lang, s, part, t.decode(), -v, k + 1) for k, (v, t) in enumerate(sorted(some))}
    return rows


def audited(docs, **kw):
    rows = D.audit_sources(docs, **kw).collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    return got


def made(n=240, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abEé日") for _ in range(r.randint(1, 6))) for _ in range(60)]
    docs = []
    for _ in range(n):
        lang = r.choice(["en", "en", "en", "de", None])
        source = r.choice(["s0", "s0", "s0", *[f"s{k}" for k in range(9)], None, "\U0001f600"])
        text = "".join(r.choice(vocabulary) + r.choice(" \n1_") for _ in range(r.choice([0, 3, 40])))
        docs.append((text, lang, source))
    return docs + [(None, "xx", "a"), ("", "xx", "b"), ("one", "xx", "c")]


SMALL = {"block": 3000, "shards": 3, "chunk": 4, "fan": 2, "room": 200}


@pytest.mark.parametrize("sizes", [{}, SMALL, {**SMALL, "shards": 1, "room": 1}])
def test_made_documents(spark, sizes, monkeypatch):
    monkeypatch.setattr(D, "pieces", lambda batches, column: (b.slice(k, 7) for b in batches for k in range(0, b.num_rows, 7)))
    docs = made()
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(7)
    assert audited(df, least=12, **sizes) == brute(docs, 12)


def test_real_documents(spark):
    docs = [(r["text"], r["lang"], r["source"]) for r in real_docs()]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(5)
    assert audited(df) == brute(docs)


def test_odd_and_empty_tables(spark):
    docs = [(r[1], r[2], r[3]) for r in odd_rows()]
    assert audited(odd_docs(spark)) == brute(docs)
    assert audited(odd_docs(spark), least=2) == brute(docs, 2)
    assert D.audit_sources(no_docs(spark)).count() == 0


def test_merge_opens_chunks_in_order():
    r = random.Random(2)
    want: dict = {}
    rows = []
    for run in range(6):
        postings = sorted({(f"t{r.randrange(80):02}".encode(), r.randrange(3)) for _ in range(60)})
        for lo in range(0, len(postings), 5):
            some = postings[lo : lo + 5]
            rows.append(dict(zip(D.RUN_NAMES, D.chunk_row(run, 0, [("l", f"{k}") for k in range(3)], [t for t, _ in some], [g for _, g in some], [run + 1] * len(some), [1] * len(some)))))
            for t, g in some:
                have = want.setdefault(t, {}).setdefault(("l", str(g)), [0, 0])
                have[0] += run + 1
                have[1] += 1
    got = list(D.merged(iter(sorted(rows, key=lambda x: x["first"]))))
    assert [t for t, _ in got] == sorted(want)
    assert dict(got) == want


def test_shares_of_great_counts():
    counts, over = np.array([10**15, 3]), np.array([4 * 10**15, 10])
    assert D.shares(counts, over).tolist() == [1 + 10**9 * (10**15 + 5) // (4 * 10**15), 1 + 10**9 * 8 // 10]
