"""Leaks, mixes and text quality against brute force and simulated pages."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwise.llm import leaks as L
from cellwise.llm import mixing as M
from cellwise.llm import page_text as P
from cellwise.llm import text_quality as T

WORDS = [a + b + c for a in ("bar", "lo", "mi", "ster", "qua") for b in ("na", "ke", "li", "vou", "tre") for c in ("n", "rd", "", "ss", "m", "lt")]


def passages(n, rng):
    return [" ".join(rng.choice(WORDS) if rng.random() < 0.6 else rng.choice(["the", "of", "and", "was", "a"]) for _ in range(rng.randint(40, 90))) for _ in range(n)]


def misread(word, rng):
    i = rng.randrange(len(word))
    return word[:i] + rng.choice("~1jq0") + word[i + 1 :]


def as_lines(words, width, rng, hyphens=True):
    lines, line = [], ""
    for w in words:
        if len(line) + len(w) + 1 > width:
            room = width - len(line) - 2
            if hyphens and 2 <= room <= len(w) - 2 and rng.random() < 0.7:
                lines.append(f"{line} {w[:room]}-".strip())
                line = w[room:]
                continue
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


def page_with(passage, length, width, noise, rng, others, mixed=False, advert=False):
    words = passage.split()
    start = rng.randrange(len(words) - length + 1)
    cut = [w.capitalize() if rng.random() < 0.2 else w for w in words[start : start + length]]
    bad = set(rng.sample(range(length), int(noise * length)))
    cut = [misread(w, rng) if i in bad else w + rng.choice(["", "", ",", "."]) for i, w in enumerate(cut)]
    body = as_lines(rng.choice(others).split()[:20] + cut + rng.choice(others).split()[:20], width, rng)
    if advert:
        body[len(body) // 2 : len(body) // 2] = ["WANTED, a new net,", "apply Holoby & Co.", "No. 7"]
    if mixed:
        side = as_lines(rng.choice(others).split() * 3, width, rng)
        body = [x for pair in zip(body, side) for x in pair]
    return "\n".join(body)


def found(index, texts):
    return {(p, index.ids[i]): n for p, i, n, _ in L.tilings(index, texts, L._Ids(index.vocabulary), L.Matcher(index))}


@pytest.mark.parametrize(("mixed", "advert", "noise", "least"), [(False, False, 0.0, 1.0), (False, True, 0.0, 0.95), (True, False, 0.0, 0.95), (False, False, 0.15, 0.95), (True, True, 0.1, 0.95), (False, False, 0.25, 0.95)])
def test_planted_passages_are_found(mixed, advert, noise, least):
    rng = random.Random(hash((mixed, advert, noise)) % 1000)
    items = passages(40, rng)
    others = passages(60, rng)
    index = L.Index.build(list(enumerate(items)))
    texts = [page_with(items[i % 40], rng.randint(20, 40), rng.choice([26, 34, 60]), noise, rng, others, mixed, advert) for i in range(120)]
    got = found(index, texts)
    assert sum((i, i % 40) in got for i in range(120)) >= least * 120
    assert all(k[1] == k[0] % 40 for k in got)


def test_short_quotes_and_replaced_words_are_no_leak():
    rng = random.Random(5)
    items, others = passages(40, rng), passages(60, rng)
    index = L.Index.build(list(enumerate(items)))
    short = [page_with(items[i], rng.randint(5, 12), 40, 0.0, rng, others) for i in range(40)]
    replaced = []
    for i in range(40):
        words = items[i].split()
        for j in range(0, len(words), 7):
            words[j] = rng.choice([w for w in WORDS if w != words[j]])
        replaced.append("\n".join(as_lines(words, 50, rng)))
    assert found(index, short) == {} and found(index, replaced) == {}


def test_whole_and_odd_texts():
    rng = random.Random(6)
    items = passages(3, rng)
    index = L.Index.build([*enumerate(items), (7, None), (8, ""), (9, "too short")])
    texts = [None, "", "\n\n", items[0], items[1].upper().replace(" ", ",\n"), items[2] + " | " + items[0], ("x " * 200_000) + "\n" + items[1], items[0] + "\n" + items[0], "~ ~ ~\n. . ."]
    got = found(index, texts)
    assert set(got) == {(3, 0), (4, 1), (5, 2), (5, 0), (6, 1), (7, 0)}
    assert L.tilings(L.Index.build([]), texts, L._Ids({}), L.Matcher(L.Index.build([]))) == []


def test_long_pages_are_cut_without_loss(monkeypatch):
    rng = random.Random(8)
    items, others = passages(6, rng), passages(30, rng)
    index = L.Index.build(list(enumerate(items)))
    lines = [line for o in others * 3 for line in as_lines(o.split(), 40, rng)]
    page = "\n".join(lines[:200] + as_lines(items[2].split(), 40, rng) + lines[200:400] + [" ".join(others * 5 + [items[4]] + others * 5)])
    wanted = found(index, [page])
    assert set(wanted) == {(0, 2), (0, 4)}
    for size in (40, 60, 100):
        monkeypatch.setattr(L, "BATCH_WORDS", size * 3)
        monkeypatch.setattr(L, "PIECE_WORDS", size + 90)
        assert found(index, [page, page]) == {(p, i): n for (_, i), n in wanted.items() for p in (0, 1)}
    again = "\n".join([items[0][:60]] * 20_000)
    assert found(index, [again]) == {}


@pytest.mark.parametrize("batch", [30_000, 60])
def test_any_lines_may_stand_between(monkeypatch, batch):
    """Stretches under 15 words on both sides of a long advert, or of columns scanned out of order, are one leak, in one batch or in several."""
    monkeypatch.setattr(L, "BATCH_WORDS", batch)
    rng = random.Random(13)
    item = " ".join(rng.sample(WORDS, 40))
    index = L.Index.build([(0, item)])
    ws = item.split()
    for gap in (3, 13, 20, 200):
        advert = [f"Notice {i} zebra quilt, yonder" for i in range(gap)]
        whole = [" ".join(ws[5:10]), " ".join(ws[10:14]), *advert, " ".join(ws[14:18]), " ".join(ws[18:23]), "Yonder zebra"]
        assert found(index, ["\n".join(whole)]) == {(0, 0): 18}, gap
        backwards = [" ".join(ws[14:18]), " ".join(ws[18:23]), *advert, " ".join(ws[5:10]), " ".join(ws[10:14])]
        assert found(index, ["\n".join(backwards)]) == {(0, 0): 18}, gap


def test_tiling_goes_on_after_the_first_leak():
    """A page that breaks a passage in three, its longest part neither first nor with the longest tile."""
    ws = random.Random(14).sample(WORDS, 70)
    index = L.Index.build([(0, " ".join(ws))])
    lines = [ws[50:66], ["zebra"], ws[:12], ws[12:24], ws[24:36], ["zebra"]]
    text = "\n".join(" ".join(line) for line in lines)
    assert L.tilings(index, [text], L._Ids(index.vocabulary), L.Matcher(index)) == [(0, 0, 36, 52)]


@pytest.mark.parametrize("order", [(4, 3, 2, 1, 0), (3, 1, 4, 0, 2)])
@pytest.mark.parametrize("between", [0, 100])
def test_reordered_pieces_are_found_by_coverage(order, between):
    rng = random.Random(15)
    items = [" ".join(rng.sample(WORDS, 60)) for _ in range(5)]
    index = L.Index.build(list(enumerate(items)))
    texts = []
    for n in range(50):
        ws = items[n % 5].split()
        lines: list[str] = []
        for k in order:
            lines += as_lines(ws[12 * k : 12 * k + 12], 44, rng)
            lines += as_lines([rng.choice("zebra quilt yonder notice oxen vellum".split()) for _ in range(between)], 44, rng) if between else ["zebra quilt"]
        texts.append("\n".join(lines))
    got = {(p, i): (n, c) for p, i, n, c in L.tilings(index, texts, L._Ids(index.vocabulary), L.Matcher(index))}
    assert set(got) == {(n, n % 5) for n in range(50)}
    assert all(n >= 12 and c >= 40 for n, c in got.values())  # pieces that end with their lines are joined again
    third = ["\n".join(" ".join(items[0].split()[12 * k : 12 * k + 12]) + " zebra\nyonder" for k in (4, 0))]
    assert L.tilings(index, third, L._Ids(index.vocabulary), L.Matcher(index)) == []


def test_tiles_use_no_word_twice():
    """The longest tile is marked first; one that overlaps it counts with its free words only, a copy of it not at all."""
    ws = random.Random(16).sample(WORDS, 40)
    index = L.Index.build([(0, " ".join(ws))])
    text = "\n".join([" ".join(ws[:20]), "zebra", " ".join(ws[10:30]), "zebra", " ".join(ws[:20])])
    assert L.tilings(index, [text], L._Ids(index.vocabulary), L.Matcher(index)) == [(0, 0, 20, 30)]


def test_leaks_in_frames(spark, monkeypatch):
    rng = random.Random(7)
    items = passages(5, rng)
    pages = spark.createDataFrame([(1, items[0]), (2, None), (2, items[3]), (2, items[3]), (3, "nothing")], "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    held = spark.createDataFrame(list(enumerate(items)) + [(99, None)], "item_id bigint, passage string")
    wanted = [(1, 0), (2, 3), (2, 3)]
    for chunk in (5000, 2):
        monkeypatch.setattr(L, "INDEX_ITEMS", chunk)
        out = L.leaked(pages, F.col("doc_id"), F.col("text"), held, F.col("item_id"), F.col("passage"))
        assert sorted((r.doc_id, r.item_id) for r in out.collect()) == wanted
    assert L.leaked(pages, F.col("doc_id"), F.col("text"), held.limit(0), F.col("item_id"), F.col("passage")).count() == 0
    assert L.leaked(pages.limit(0), F.col("doc_id"), F.col("text"), held, F.col("item_id"), F.col("passage")).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 1000, 4097])
def test_index_permutation(size):
    assert sorted(M.permute(np.arange(size), size, 5).tolist()) == list(range(size))
    assert not size > 10 or M.permute(np.arange(size), size, 5).tolist() != M.permute(np.arange(size), size, 6).tolist()


def test_shard_draws_add_up_and_vary():
    totals = np.array([1000, 300, 7, 0])
    shards, size = 13, 101
    upto = np.zeros(4, np.int64)
    counts = []
    for s in range(shards):
        begin, n = M.shard_counts(totals, shards, size, s, 3)
        assert (begin == upto).all() and n.sum() == min(size, totals.sum() - s * size)
        upto = upto + n
        counts.append(n[0])
    assert (upto == totals).all() and len(set(counts[:-1])) > 1


@pytest.mark.parametrize(("good", "bad", "draws"), [(7, 5, 6), (300, 50, 100), (40_000, 60_000, 30_000)])
def test_hypergeometric_draws(good, bad, draws):
    ours, theirs = np.random.default_rng(1), np.random.default_rng(2)
    a = np.array([M.hypergeometric(good, bad, draws, ours) for _ in range(4000)])
    b = theirs.hypergeometric(good, bad, draws, 4000)
    assert abs(a.mean() - b.mean()) < 5 * b.std() / 4000**0.5 + 1e-9 and abs(a.std() / b.std() - 1) < 0.1
    assert a.min() >= max(0, draws - bad) and a.max() <= min(good, draws)


def test_draws_are_one_method_at_all_sizes():
    for n in (10**8, 10**9 - 1, 10**9, 10**10):
        k = np.array([M.hypergeometric(n, 3 * n, n, np.random.default_rng(i)) for i in range(20)])
        sd = (n * 0.25 * 0.75 * 0.75) ** 0.5
        assert (abs(k - n / 4) < 6 * sd).all() and 0.4 * sd < k.std() < 2 * sd
    assert M.hypergeometric(5, 0, 3, np.random.default_rng(0)) == 3 and M.hypergeometric(0, 5, 3, np.random.default_rng(0)) == 0
    assert M.hypergeometric(4, 3, 7, np.random.default_rng(0)) == 4 and M.hypergeometric(0, 0, 0, np.random.default_rng(0)) == 0
    known: dict = {}
    totals = np.array([1000, 300, 7, 0])
    for s in range(13):
        a, b = M.shard_counts(totals, 13, 101, s, 3), M.shard_counts(totals, 13, 101, s, 3, known)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_fill_respects_caps():
    given = M.fill(np.array([0.5, 0.3, 0.2]), np.array([10.0, 1000, 1000]), 100)
    assert given[0] == 10 and abs(given.sum() - 100) < 1e-9 and abs(given[1] / given[2] - 1.5) < 1e-9
    assert M.fill(np.array([0.5, 0.5]), np.array([3.0, 4.0]), 100).tolist() == [3.0, 4.0]
    assert M.fill(np.array([]), np.array([]), 10).tolist() == []


def test_blocks_are_a_round_trip(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice(["", None, "the lamp was lit " * rng.randint(1, 300), "ümläut ~ 7"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("block", F.lit("clash")).repartition(5)
    blocks = M.pack(df, F.col("doc_id"), F.col("source"), F.col("text"), length=64).collect()
    coder = M.encoder(M.TOKENIZER)
    wanted = defaultdict(Counter)
    for _, s, t in rows:
        wanted[s].update(coder.encode_ordinary(t or ""))
    by = defaultdict(list)
    for b in blocks:
        by[b.source].append(b)
    for s, bs in by.items():
        bs.sort(key=lambda b: b.block)
        assert [b.block for b in bs] == list(range(len(bs)))
        assert all(b.n_tokens == 64 for b in bs[:-1]) and all(len(b.tokens) == 2 * b.n_tokens for b in bs)
        assert Counter(np.concatenate([np.frombuffer(b.tokens, np.uint16) for b in bs]).tolist()) == wanted[s]
    sizes = {r.source: r.size for r in M.source_sizes(M.token_counts(df, {"source": F.col("source")}, F.col("text"))).collect()}
    assert sizes == {s: sum(c.values()) for s, c in wanted.items()}
    assert M.pack(df.limit(0), F.col("doc_id"), F.col("source"), F.col("text")).count() == 0


def test_mix_meets_shares_and_caps(spark):
    text = "the lamp was lit at noon and the crew sailed home . " * 60
    rows = [(i, s, text) for s, n in (("a", 60), ("b", 6), ("c", 30), (None, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.1, 3), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    whole = M.mix(df, F.col("doc_id"), F.col("source"), F.col("text"), targets)
    mixed = whole.rows.cache()
    shares = {r.source: r for r in M.reached(whole).collect()}
    size = {r.source: r for r in M.capacities(M.source_sizes(M.token_counts(df, {"source": F.col("source")}, F.col("text"))), targets).collect()}
    assert {s for s, r in size.items() if r.short} == {"b", "gone"}
    assert shares["b"].repeats == 2 and shares["b"].tokens == size["b"].capacity and shares["gone"].tokens == 0
    assert abs(shares["a"].tokens / shares["c"].tokens - 5) < 0.2
    assert mixed.groupBy("source", "block").count().join(targets, "source").where("count > max_repeats").count() == 0
    assert mixed.select("shard", "slot").distinct().count() == mixed.count()
    total = sum(r.size for r in M.source_sizes(M.token_counts(df, {"source": F.col("source")}, F.col("text"))).collect())
    assert abs(sum(r.tokens for r in shares.values()) / total - 1) < 0.08
    assert {s: r.short for s, r in shares.items()} == {s: r.short for s, r in size.items()}
    empty = M.mix(df.limit(0), F.col("doc_id"), F.col("source"), F.col("text"), targets)
    assert M.reached(empty).where("short OR tokens > 0").count() == 0
    none = empty.rows
    assert none.count() == 0


def test_exact_tails(spark):
    rng = random.Random(10)
    rows = [(s, g, float(rng.choice([0, 0, 0, rng.randint(0, 40)])), rng.choice([True, True, False, None])) for s in (0, 1) for g in ("en", "pt", None) for _ in range(300)]
    got = T.exact_tails(spark.createDataFrame(rows, "stat int, grp string, value double, ref boolean"), 7).collect()
    by = defaultdict(list)
    for s, g, v, ref in rows:
        by[s, g].append((v, ref))
    assert len(got) == sum(len({v for v, _ in vs}) for vs in by.values())
    for r in got:
        vs = [v for v, ref in by[r.stat, r.grp] if ref]
        n = len(vs) + 1
        assert abs(r.left - (sum(v <= r.value for v in vs) + 1) / n) < 1e-12 and abs(r.right - (sum(v >= r.value for v in vs) + 1) / n) < 1e-12
        assert r["skew"] == 1 and r.n_ref == len(vs) and r.n_rows == sum(v == r.value for v, _ in by[r.stat, r.grp])


@pytest.mark.parametrize("hot", [10_000, 3])
def test_outlier_scores(spark, monkeypatch, hot):
    monkeypatch.setattr(T, "HOT", hot)
    rng = random.Random(11)
    rows = [(i, rng.choice(["en", "pt"]), round(rng.gauss(5, 1), 1), rng.choice([0.0, 0.0, 0.0, rng.gauss(5, 1)])) for i in range(400)] + [(900, "en", 5.0, 60.0), (901, None, 5.0, 5.0), (902, "en", None, 5.0)]
    schema = "doc_id bigint, lang string, a double, b double"
    everyone = F.lit(True)
    out = {r.doc_id: r for r in T.outlier_scores(spark.createDataFrame(rows, schema).withColumn("ref", F.lit("clash")), ["a", "b"], everyone).collect()}
    assert set(out) == {r[0] for r in rows}

    def brute(i, lang):
        own = [r for r in rows if lang is None or r[1] == lang]
        me = next(r for r in rows if r[0] == i)
        l = h = a = 0.0
        for k in (2, 3):
            vs = [r[k] for r in own if r[k] is not None]
            if me[k] is None:
                continue
            low, high = (-math.log((sum(v <= me[k] for v in vs) + 1) / (len(vs) + 1)), -math.log((sum(v >= me[k] for v in vs) + 1) / (len(vs) + 1)))
            mean = sum(vs) / len(vs)
            third = sum((v - mean) ** 3 for v in vs)
            l, h, a = l + low, h + high, a + (low if third < 0 else high)
        return max(l, h, a)

    for i in (0, 1, 17, 399, 900, 902):
        assert abs(out[i].score - brute(i, out[i].lang)) < 1e-9 and abs(out[i].score_all - brute(i, None)) < 1e-9
    assert out[901].score_all > 0 and out[901].n_ref == 1
    assert T.outlier_scores(spark.createDataFrame([], schema), ["a", "b"], everyone).count() == 0
    nobody = T.outlier_scores(spark.createDataFrame(rows, schema), ["a", "b"], F.lit(False))
    assert nobody.where("score_all <> 0 OR n_ref_all <> 0").count() == 0 and nobody.where(T.beyond_reference()).count() == len(rows)


@pytest.mark.parametrize("junk", [0.02, 0.5, 0.95])
def test_ranks_lose_no_outlier_however_many(spark, junk):
    rng = random.Random(12)
    rows = [(i, rng.choice(["en", "pt"]), rng.gauss(5, 1), rng.uniform(0, 0.3) if i < junk * 600 else rng.uniform(0.5, 1)) for i in range(600)]
    out = T.outlier_scores(spark.createDataFrame(rows, "doc_id bigint, lang string, a double, share double"), ["a", "share"], F.col("share") >= 0.5)
    found = {r.doc_id for r in out.where(T.beyond_reference()).collect()}
    assert found >= {r[0] for r in rows if r[3] <= 0.3}
    assert len(found) <= len(rows) * (junk + 0.1 * (1 - junk))


COMMON = frozenset("the of and was a to in that it with had by".split())
PROSE = """It was said that the harbour and the
committee printed no pump in spite of the
storm. The lamp of the garrison was lit by
a sergeant who had sailed with the crew to
the town and the bakery of the parish."""
LISTS = [
    "\n".join(f"{w.capitalize()} ..................... {i} {i * 3 % 7}" for i, w in enumerate(WORDS[:12])),
    "\n".join(f"{i}  {i * 7 % 90}  {i * 1.5:.2f}  {i * 3}" for i in range(12)),
    "\n".join(f"For the {w} of the {WORDS[-i - 1]}, {i}s." for i, w in enumerate(WORDS[:12])),
    "\n".join(f"{i} -- {w.capitalize()}, {i * 31} tons, from {WORDS[-i - 1].capitalize()}" for i, w in enumerate(WORDS[:12])),
    "\n".join(["It was said that the harbour and the c"] * 12),
    "I t w a s s a i d\nt h a t t h e h a r\nb o u r a n d t h e\nc o m m i t t e e",
    "Itwassaidthatthe harbourandthecommittee\nprintednopumpinspite ofthestorm",
    "il1 ,'- ' I.,' l1\n-il .,'- il1I ,'- '\n|$ &--/]$ <}{-i!#",
    "DROUGHT IN THE TOWN\nTHE FIRE AND THE WELL",
]


def test_running_lines():
    share = lambda t: P.page_statistics(t, P.Tokens(COMMON))[-1]
    assert share(PROSE) == 1.0
    assert share(PROSE.replace("h", "b", 3)) == 1.0
    assert share(PROSE.upper()) == 1.0
    for text in LISTS:
        assert share(text) <= 0.2, text
    mixed = "\n".join(x for pair in zip(PROSE.split("\n"), LISTS[0].split("\n")) for x in pair)
    assert share(mixed) == 0.5
    assert P.page_statistics("", P.Tokens(COMMON)) is None and P.page_statistics(" \n ", COMMON) is None and P.statistics([None, ""], COMMON) == [None, None]
    assert P.page_statistics("word " * 300_000, P.Tokens(COMMON))[0] == 300_000


def test_page_statistics_by_hand():
    got = dict(zip(P.STATISTICS, P.page_statistics("The cat, 12!\nof x", P.Tokens(COMMON)), strict=True))
    assert got["n_words"] == 5 and got["mean_word_length"] == 11 / 5 and got["end_punctuation_share"] == 0.5 and got["common_word_share"] == 2 / 5
    assert abs(got["symbol_ratio"] - 2 / 13) < 1e-12


def test_page_table(spark):
    df = spark.createDataFrame([(1, "en", PROSE), (2, None, None), (3, "en", " "), (4, None, LISTS[0])], "doc_id bigint, lang string, text string").withColumn("n_words", F.lit("clash"))
    got = T.page_table(df, F.col("doc_id"), F.col("lang"), F.col("text"), P.STATISTICS, lambda texts: P.statistics(texts, COMMON))
    assert {(r.doc_id, r.lang) for r in got.collect()} == {(1, "en"), (4, None)}
    assert T.page_table(df.limit(0), F.col("doc_id"), F.col("lang"), F.col("text"), P.STATISTICS, lambda texts: P.statistics(texts, COMMON)).count() == 0


@pytest.mark.parametrize("kinds", [(0, 1), (0,), (1,), ()])
def test_p9_found_runs_no_stage_without_effect(spark, monkeypatch, tmp_path, kinds):
    from cellwise.llm import queries_texts as Q

    pages = [(i, ["en", "pt", None][i % 3], t) for i, t in enumerate([*LISTS, *[PROSE.replace("h", "b", i) for i in range(9)], None, "", " \n "])]
    kind = lambda t: int(not (t or "").strip()) * 2 or int(t in LISTS)
    kept = [p for p in pages if kind(p[2]) == 2 or kind(p[2]) in kinds]
    spark.createDataFrame(kept, "doc_id bigint, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string").write.parquet(str(tmp_path / "common_words.parquet"))
    wanted = {p[0] for p in kept if p[2] in LISTS}
    # what the ranks of these pages select holds every page with too few running lines: asked first or not, the rows are the same
    scored = Q.p9_statistics(spark, str(tmp_path)).where(f"running_line_share < {Q.RUNNING_SHARE}")
    assert {r.doc_id for r in scored.collect()} == {r.doc_id for r in scored.where(T.beyond_reference()).collect()} == wanted

    def unused(*_):
        raise AssertionError("ranks or scores that decide nothing")

    monkeypatch.setattr(T, "exact_tails", unused)
    monkeypatch.setattr(T, "outlier_scores", unused)
    rows = [r.doc_id for r in Q.p9_found(spark, str(tmp_path)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted


def test_queries_run(spark, sf):
    from oracle import connect, rows_of, rows_of_sql

    from cellwise.llm.queries import ORACLES, QUERIES

    con = connect(sf)
    for name, q in QUERIES.items():
        names, rows = rows_of(q(spark, sf))
        assert name not in ORACLES or (names, rows) == rows_of_sql(con, ORACLES[name]), name
