"""Language identification, personal data and decontamination."""
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillmap.llm import decontamination, fm_index
from rillmap.llm.decontamination import contaminated, find_contamination, n_hit, text_spans
from rillmap.llm.language import UNKNOWN, held_out, identify_language, train
from rillmap.llm.personal_data import KINDS, all_spans, base_spans, decode, find_personal_data, fit, luhn, redact, regions
from rillmap.llm.personal_data import train as train_spans

from .conftest import SCHEMA, corpus, prose


def test_language_accuracy(spark):
    """Held-out accuracy on two invented languages, with null, letterless and unlabelled rows."""
    from pyspark.sql import functions as F
    rows = [(i, prose(50 + i % 2, 60) + " " + prose(1000 + i, 5), ["aa", "bb"][i % 2]) for i in range(200)]
    rows += [(500, None, "aa"), (501, " 12 !", "aa"), (502, prose(50, 50), None), (None, prose(51, 50), "aa")]
    found = identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).withColumn("out", held_out(F.col("doc_id")))
    got = {r["doc_id"]: r for r in found.collect()}
    test = [r for i, r in got.items() if i is not None and i < 200 and r["out"]]
    assert len(test) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in test]) > 0.95
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == UNKNOWN and got[500]["score"] == 0
    assert got[502]["lang_pred"] == "aa" and got[None]["lang_pred"] == "bb" and not got[None]["out"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_without_labels(spark, docs, no_docs):
    from pyspark.sql import functions as F
    found = identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(found) == len(corpus()) and {(r["lang_pred"], r["score"]) for r in found} == {(UNKNOWN, 0.0)}
    assert found[0].asDict().keys() - {"lang_pred", "score"} == {c.split()[0] for c in SCHEMA.split(", ")} - {"score"}
    assert identify_language(no_docs).count() == 0
    with pytest.raises(ValueError):
        train(spark.createDataFrame([(i, "x", f"l{i}") for i in range(70)], "doc_id long, text string, lang string"))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) \
                or kind == "phone" and 9 <= len(digits) <= 15
            if good:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab1204.@@+- ()\n%é"), max_size=60))
def test_base_spans(text):
    assert base_spans(text) == plain_spans(text)


def test_base_spans_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1 " * 60_000, "a@" * 90_000):
        assert isinstance(base_spans(text), list)


def test_training_sample_ignores_copies(spark, monkeypatch):
    """Copies of one stretch in many batches take no places of others in the sample."""
    from pyspark.sql import functions as F
    from rillmap.llm import personal_data
    monkeypatch.setattr(personal_data, "TRAIN_REGIONS", 5)
    docs = spark.createDataFrame([(f"write to user{i}.x@mail{i}.example.com or call +1 (555) 010-{1000 + i} today",) for i in range(12)], "text string")
    seen = []
    monkeypatch.setattr(personal_data, "fit", lambda examples: seen.append(examples))
    train_spans(docs.coalesce(1))
    train_spans(docs.crossJoin(spark.range(40)).repartition(40, F.col("id")))
    assert seen[0] == seen[1] and len({t for t, _ in seen[0]}) > 5


def test_personal_data(spark, no_docs):
    texts = [f"write to user{i}.x@mail{i}.example.com or call +1 (555) 010-{1000 + i} today" for i in range(30)] + ["host 10.0.3.7 pays 4111 1111 1111 1111 now"] * 3
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "only (555) 010-7777 here"), (93, "clean words and 12 cats"), (None, "10.1.1.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in find_personal_data(docs, ["doc_id"]).collect()}
    for d, t in rows:
        base = [(s["start"], s["stop"], s["kind"]) for s in got[d]["base"]]
        spans = [(s["start"], s["stop"], s["kind"]) for s in got[d]["spans"]]
        assert base == plain_spans(t or "") and set(base) <= set(spans)
        assert all(a >= e or s >= b for a, b, k in spans if (a, b, k) not in base for s, e, _ in base)
    assert not got[93]["spans"] and [s["kind"] for s in got[92]["spans"]] == ["phone"]
    assert find_personal_data(no_docs, ["doc_id", "score"]).count() == 0
    assert train_spans(no_docs) is None


def test_segment_model_learns_and_decodes():
    examples = [(f"ab call +1 (555) 010-{i} now", [(8, 8 + len(f"+1 (555) 010-{i}"), "phone")]) for i in range(1000, 1040)]
    weights = fit(examples + [(f"ab has {i} cats now", []) for i in range(40)])
    text = "xy call +1 (333) 444-5555 now"
    assert decode(next(regions(text)), weights) == [(8, 25, "phone")]
    assert not any(decode(r, weights) for r in regions("ab has 77 cats now"))
    assert fit([("no spans 1 here", [])]) is None and all_spans("x@y.z", None) == ([(0, 5, "email")],) * 2
    assert redact("a x@y.z b", [(2, 7, "email"), (3, 7, "ip")]) == "a <email> b"
    long = "12 ab " * 5000
    assert [r.starts[0] for r in regions(long)] == sorted(r.starts[0] for r in regions(long))


LOW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low_words(text):
    return LOW.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_hits(docs, items, size=13):
    owners = {}
    for item, text in items:
        w = low_words(text)
        k = min(size, len(w))
        for j in range(len(w) - k + 1 if k and item is not None else 0):
            owners.setdefault(tuple(w[j:j + k]), set()).add(str(item))
    out = []
    for d, t in docs:
        w, names = low_words(t), set()
        hit = [False] * len(w)
        for k in {len(x) for x in owners}:
            for j in range(len(w) - k + 1):
                if own := owners.get(tuple(w[j:j + k])):
                    names |= own
                    hit[j:j + k] = [True] * k
        out.append((d, len(w), sum(hit), sorted(names), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [8 << 20, 150])
def test_decontamination(spark, docs, no_docs, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    texts = dict(corpus())
    w = texts[12].split()
    items = [(10, " ".join(w[100:140]).upper()), (9, texts[11]), (9, texts[11]), (3, "Word"), (4, "été, ça!"), (5, ""), (6, None), (None, texts[20]), (7, prose(77, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = find_contamination(docs, bench, ["doc_id", "text"]).withColumns({"hit": n_hit(), "bad": contaminated()}).collect()
    key = lambda r: tuple((x is not None, x) for x in r[:2])
    got = [(r["doc_id"], r["n_words"], r["hit"], list(r["items"]), r["bad"]) for r in rows]
    assert sorted(got, key=key) == sorted(brute_hits(corpus(), items), key=key) and sum(r[4] for r in got) >= 5
    for r in rows:
        cut = [r["text"][a:b] for a, b in text_spans(r["text"] or "", [(s["start"], s["stop"]) for s in r["word_spans"]])]
        assert sum(len(low_words(c)) for c in cut) == r["hit"]
    assert find_contamination(no_docs, bench, ["doc_id"]).count() == 0
    assert find_contamination(docs, bench.where("item_id = 5"), ["doc_id"]).where("size(items) > 0").count() == 0


def test_fm_index():
    rng = np.random.default_rng(6)
    for trial in range(30):
        text = rng.integers(0, 2 + trial % 6, rng.integers(1, 400))
        index = fm_index.FMIndex(text, 8)
        for m in (1, 3, 7):
            patterns = np.array([rng.integers(1, 3 + trial % 6, m) for _ in range(20)] + [text[i:i + m] for i in range(0, max(0, len(text) - m), 9) if (text[i:i + m] > 0).all()])
            low, high = index.count(patterns)
            for p, a, b in zip(patterns, low, high):
                want = [i for i in range(len(text) - m + 1) if (text[i:i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want



def test_language_of_a_text_depends_on_no_other(spark):
    """Naive Bayes with dictionaries gives the same scores, alone, between others and in any partitioning."""
    import math
    from collections import Counter, defaultdict

    from rillmap.llm import language

    def bucket(gram):
        held = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
        for c in gram:
            held = ((held ^ ord(c)) * 0x85EBCA6B) & 0xFFFFFFFF
            held ^= held >> 15
        return held >> 16

    def grams(text):
        flat = "".join(c if ord(c) > 127 or "a" <= c <= "z" else " " for c in text.lower())
        padded = flat + "   "
        return [bucket(padded[i:i + n]) for i in range(len(flat) + 1) for n in language.ORDERS]

    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the hat", "en"), ("le chat et l'été", "fr"), ("ab", "en"), ("où ça", "fr"), ("x", "fr"), ("", None), ("ab xyz", None), ("été", None),
                                                        ("the", None), ("ab", None), ("12", None), (None, "en")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    counts, size = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        if t is not None and lang:
            counts[lang].update(grams(t))
            size[lang] += 1
    total = {k: sum(c.values()) + language.SMOOTHING * language.BUCKETS for k, c in counts.items()}
    for parts in (1, 5):
        for r in language.predict(docs.repartition(parts), model).collect():
            if not language.has_letter(r["text"]):
                assert (r["lang_pred"], r["score"]) == ("und", 0)
                continue
            logs = {k: math.log(size[k] / sum(size.values())) + sum(math.log((counts[k][g] + language.SMOOTHING) / total[k]) for g in grams(r["text"])) for k in counts}
            best = max(sorted(logs), key=logs.get)
            assert r["lang_pred"] == best and abs(r["score"] - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-9
    alone = language._sums(["ab"], model.weight)
    assert (alone[0] == language._sums(["ab", "xyz"], model.weight)[0]).all() and (alone[0] == language._sums(["q", "ab", "xyz"], model.weight)[1]).all()


def test_texts_without_words_meet_no_item(spark):
    docs = spark.createDataFrame([(1, "!? ..."), (2, ""), (3, None)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert [tuple(r) for r in find_contamination(docs, bench, ["doc_id"]).select("doc_id", "n_words", "items").orderBy("doc_id").collect()] == [(1, 0, []), (2, 0, []), (3, 0, [])]
