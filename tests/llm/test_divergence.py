"""Source divergence against a dense count in plain Python, with shared digests and several tiles forced."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.llm import divergence
from furlong.llm.divergence import SCALE, share, shares, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, digest int, term string, p int, id string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs, top):
    groups, docs, counts = collections.defaultdict(set), collections.Counter(), collections.Counter()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall(lower(text or ""))
        docs.update({(lang, t) for t in terms})
        counts.update((lang, source, t) for t in terms)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for (g, t), n in docs.items() if g == lang and n >= min_docs)
        total = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + SCALE * (counts[lang, s, t] + 1) // (total[s] + len(kept)) for s in sources for t in kept}
        all_n = {t: sum(counts[lang, s, t] for s in sources) for t in kept}
        q = {t: 1 + SCALE * (all_n[t] + 1) // (sum(total.values()) + len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum((p[s, t] - p[o, t]) ** 2 // p[o, t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s, t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s, t] and p[s, t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                cut = items if part == "pair" else items[:top]
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(cut, 1)}
    return out


def corpus(n=300, sources=9, seed=5):
    rng = random.Random(seed)
    bag = [f"{a}{b}" for a in ["ka", "Lo", "é", "zu", "日本", "it's", "x1y"] for b in ["m", "n", "ß", "", "-q", " r"]]
    rows = []
    for k in range(n):
        text = " ".join(rng.choices(bag, k=rng.choice([0, 1, 5, 30, 80])))
        rows.append((k, text, rng.choice(["en", "de", None]), f"s{rng.randrange(sources)}", 1, "t", 2, "i"))
    rows += [(7, "same same", "en", "s0", 1, "t", 2, "i")] * 3  # repeated rows
    rows += [(None, None, None, None, None, None, None, None), (1, "", "fr", "alone", 1, "t", 2, "i")]
    rows += [(2, "rare words only here", "xx", s, 1, "t", 2, "i") for s in ("a", "b")]  # none is kept
    rows.append((3, "KA" * 60_000 + " " + "lom " * 50_000, "en", "s1", 1, "t", 2, "i"))
    return rows


@pytest.mark.parametrize(("bits", "sent", "top"), [(64, 1000, 200), (3, 0, 4), (1, 5, 1)])
def test_equals_a_dense_count(spark, bits, sent, top):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = source_divergence(docs, top=top, digest_bits=bits, groups_sent=sent).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows, 3, top)


def test_a_source_with_a_third_of_all_rows_and_an_empty_table(spark):
    rows = [(k, "hot word number " + "abc"[k % 3], "en", "hot" if k % 3 else f"s{k % 5}", 1, "t", 2, "i") for k in range(200)]
    got = source_divergence(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute(rows, 3, 200)
    assert source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_text_longer_than_a_slice_is_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 5)
    text = "ab cdefghijkl é日本 x y".encode()
    pieces = list(divergence.slices(text))
    assert b"".join(pieces) == text and len(pieces) > 1
    assert [t for p in pieces for t in divergence.TERM.findall(p)] == divergence.TERM.findall(text)


def test_counts_beyond_a_long_stay_exact(spark):
    big = [(9_000_000_001, 20_000_000_000, 7), (10**12, 3 * 10**12, 10**6), (0, 0, 1), (8_999_999_999, 9 * 10**9, 3)]
    rows = spark.createDataFrame(big, "n bigint, total bigint, v bigint")
    got = [r.p for r in rows.select(share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()]
    want = [1 + SCALE * (n + 1) // (t + v) for n, t, v in big]
    n, total, v = (np.array(x) for x in zip(*big))
    assert got == want == shares(n, total + v).tolist()
