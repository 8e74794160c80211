"""Leaked passages: the search against a plain one, and what counts as a leak."""

import random
import re

import numpy as np
import pytest

from spindrift.llm import leaks as L

WORDS = "the unit quick spikes tall drift under probe rapid seven waves copper lantern orbit maple violin harbour pencil granite meadow thunder velvet compass ribbon walnut saddle bishop candle ferry goblet".split()


def passage(rng, n=60):
    return " ".join(rng.choice(WORDS) + (f" {rng.randrange(1000)}" if rng.random() < 0.15 else "") for _ in range(n))


@pytest.mark.parametrize("alphabet", ["abc1", "\u0434\u0436b1", "\u4e2d\u6587\u5b57\U00020001"])
def test_search_finds_what_a_plain_search_finds(alphabet):
    rng = random.Random(1)
    text = "".join(rng.choice(alphabet) for _ in range(60_000))
    patterns = sorted({text[i : i + L.WINDOW] for i in range(0, 50_000, 997)} | {"".join(rng.choice(alphabet) for _ in range(L.WINDOW)) for _ in range(100)})
    plain = text[:30_000] + "\0" + text[30_000:]
    letters = lambda s: np.array([0 if c == "\0" else L.letters(c)[0] for c in s], np.uint32)
    at, which = L.Patterns(np.concatenate([letters(p) for p in patterns])).search(letters(plain))
    want = {(m.start(), k) for k, p in enumerate(patterns) for m in re.finditer(f"(?={p})", plain)}
    assert set(zip(at.tolist(), which.tolist(), strict=True)) == want and len(want) > 50
    assert len(L.Patterns(letters("abcabcabcabc")).search(np.zeros(3, np.uint32))[0]) == 0


def test_folding():
    assert L.fold("Ünit <b>5</b>,&nbsp;A­-B!") == b"unit5ab"
    assert L.fold("\u0414\u043e\u043c, <i>5</i> \u4e2d\u6587!") == "\u0434o\u043c5\u4e2d\u6587" and L.fold("5 \u00b5s Ma\u00df") == b"5usmass" and L.fold("d\u0435ar") == b"dear"
    assert len(L.word_places("\u4e2d\u6587\u5b57 abc")) == 4 and len(L.word_places("e\u0301te\u0301 \u043c\u0438\u0440")) == 2
    assert L.codes(L.letters("\u4e2d\u6587abc")).max() < L._BASE and L.codes(L.letters("\u4e2d")).min() > 0
    assert L.fold("") == b"" and L.fold("¡¿") == b""
    assert len(L.word_places("one two, 3")) == 3


def found(items, docs):
    m = L.Matcher(items)
    texts = [L.fold(d) for d in docs]
    return {(i, k) for i, k, _ in m.find(texts)}


def test_what_is_a_leak():
    rng = random.Random(2)
    items = [(i, passage(rng)) for i in range(30)]
    words = [p.split() for _, p in items]
    noise = lambda n: passage(random.Random(n + 99), 80)
    half = len(words[3]) // 2
    docs = [
        f"{noise(1)} {items[0][1].upper()} {noise(2)}",  # whole
        f"{noise(3)} {' '.join(words[3][: half + 6])} {noise(4)}",  # more than half
        f"{noise(5)} {' '.join(words[4][: len(words[4]) // 4])} {noise(6)}",  # a quarter
        "<p>" + " ".join(f"<b>{w}</b>,\n" for w in words[5]) + "</p>",  # markup and layout
        " ".join(w[:-1] + "x" if i % 12 == 7 else w for i, w in enumerate(words[6])),  # spelling
        " ".join(w for i, w in enumerate(words[7]) if i % 15),  # words dropped
        " ".join(words[8][half:] + words[8][:half]),  # stretches moved
        " ".join(sorted(words[9])),  # only the same words
        noise(7),
        "",
    ]
    assert found(items, docs) == {(0, 0), (1, 3), (3, 5), (4, 6), (5, 7), (6, 8)}


def test_passages_that_share_most_of_their_windows():
    rng = random.Random(6)
    common = passage(rng, 50)
    items = [(i, f"{common} {passage(rng, 6)}") for i in range(6)]
    got = found(items, [f"so {common} it", items[2][1]])
    assert {(0, i) for i in range(6)} <= got and (1, 2) in got


@pytest.mark.parametrize("kept", [0.52, 0.53, 0.55])
def test_passages_with_a_common_opening(kept):
    """Groups of eight passages share 48 % of their words; documents give a little more than half of one."""
    rng = random.Random(8)
    items, docs, want = [], [], set()
    for group in range(20):
        opening = passage(rng, 48).split()[:48]
        for k in range(8):
            words = opening + passage(rng, 60).split()[:52]
            items.append((group * 8 + k, " ".join(words)))
            docs.append(f"{passage(rng, 40)} {' '.join(words[: round(kept * 100)])} {passage(rng, 40)}")
            want.add((len(docs) - 1, group * 8 + k))
    assert want <= found(items, docs)


def script(name, rng, n=60):
    if name == "cyrillic":
        return " ".join("".join(rng.choice("\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438\u043a\u043b\u043c\u043d\u043e\u043f\u0440\u0441\u0442") for _ in range(rng.randint(3, 9))) for _ in range(n))
    return "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(2 * n))


@pytest.mark.parametrize("name", ["cyrillic", "chinese"])
def test_copies_in_other_scripts(name):
    rng = random.Random(11)
    items = [(i, script(name, rng)) for i in range(20)]
    noise = lambda: script(name, rng, 30)
    docs = [f"{noise()} {p[: len(p) * 6 // 10] if i % 2 else p.upper()} {noise()}" for i, (_, p) in enumerate(items)] + [noise(), items[3][1][: len(items[3][1]) // 4]]
    assert found(items, docs) == {(i, i) for i in range(20)}


def test_pairs_are_laid_out_in_parts(monkeypatch):
    rng = random.Random(12)
    items = [(i, passage(rng)) for i in range(12)]
    docs = [f"{items[i % 12][1]} {items[(i + 1) % 12][1]}" for i in range(40)] + ["", "x" * 50]
    whole = found(items, docs)
    monkeypatch.setattr(L, "PAIRS", 7)
    assert found(items, docs) == whole and len(whole) == 80


def test_operator_edges(spark):
    rng = random.Random(3)
    p = passage(rng)
    long = " ".join(passage(rng, 50) for _ in range(2_000))
    docs = [(1, f"so {p} it"), (1, p), (2, None), (3, ""), (4, "short"), (5, f"{long} {p} {long}"), (None, p), (6, f"{p} {p}")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, p, "y"), (7, p, "y"), (8, None, "y"), (None, p, "y"), (9, "tiny", "y"), (10, "", "y")], "item_id bigint, passage string, doc_id string")
    got = L.leaks(df, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 7), (5, 7), (6, 7)] and all(r.part == 1.0 for r in got)
    assert L.leaks(df.limit(0), items).collect() == [] and L.leaks(df, items.limit(0)).collect() == []


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS", 3)
    rng = random.Random(4)
    passages = [passage(rng) for _ in range(10)]
    docs = spark.createDataFrame([(i, p) for i, p in enumerate(passages)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, p) for i, p in enumerate(passages)], "item_id bigint, passage string")
    assert sorted((r.doc_id, r.item_id) for r in L.leaks(docs, items).collect()) == [(i, i) for i in range(10)]
