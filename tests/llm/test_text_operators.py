"""Splitting, leakage, shared spans, near-duplicates, mixing and quality against brute force on small fixtures."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.llm import kernels, leakage, mixing, near_dup, quality, shared_spans, split

WORDS = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me", "no", "pi", "ra", "su", "te")
    for b in ("den", "fol", "gan", "her", "jin", "kor", "lim", "mas", "nor", "pel")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


# kernels


def test_window_hashes_are_equal_exactly_where_texts_are():
    r = random.Random(3)
    text = "".join(r.choice("abé😀") for _ in range(400))
    h = kernels.window_hashes(kernels.code_points(text), 6)
    by = {}
    for i, x in enumerate(h):
        by.setdefault(int(x), set()).add(text[i : i + 6])
    assert all(len(s) == 1 for s in by.values()) and len(by) == len({text[i : i + 6] for i in range(395)})


@pytest.mark.parametrize("limit", [1 << 18, 100])
def test_minimizers_guarantee(monkeypatch, limit):
    monkeypatch.setattr(kernels, "GROUP_CHARS", limit)
    r = random.Random(5)
    k, w = 8, 13
    common = "".join(r.choice("abcdef") for _ in range(k + w - 1))
    texts = ["".join(r.choice("abcdef") for _ in range(r.randrange(60))) + common + "".join(r.choice("abcdef")
        for _ in range(r.randrange(60))) for _ in range(30)] + ["", "abc"]
    own, at, val = kernels.minimizers(texts, k, w)
    seeds = {}
    for o, p, v in zip(own, at, val):
        assert 0 <= p <= len(texts[o]) - k
        seeds.setdefault(int(o), set()).add((int(v), int(p) - texts[o].find(common)))
    for a in range(29):
        assert any(0 <= off <= w - 1 and (v, off) in seeds[a + 1] for v, off in seeds[a])


def test_common_run():
    a, b = "xx" + "q" * 500 + "yy" + "z", "q" * 500 + "yw"
    s, n = kernels.common_run(a, b, 200, 198, 5)
    assert (s, n) == (2, 501) and kernels.common_run("abc", "xbc", 0, 0, 2)[1] == 0


# splitting


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#1-é", max_size=900), st.integers(20, 80), st.integers(0, 15))
def test_split_rebuilds_and_fits(text, limit, overlap):
    spans = split.split_item(text, limit, overlap, split.TEXT_LEVELS)
    assert all(0 < e - s <= limit for s, e in spans) or not text
    rebuilt, at = "", 0
    for s, e in spans:
        assert s <= at and at - s <= overlap
        rebuilt += text[at:e]
        at = e
    assert rebuilt == text


def test_split_cuts_at_headings_and_paragraphs():
    text = "1. One\n" + "a b. " * 10 + "\n2. Two\n" + "c d. " * 10
    assert [text[s:e][:2] for s, e in split.split_item(text, 70, 0, split.TEXT_LEVELS)] == ["1.", "2."]
    path = " > ".join(["Level number"] * 30)
    assert all(path[s:e].endswith("> ") or e == len(path) for s, e in split.split_item(path, 100, 0, split.PATH_LEVELS))


def test_split_oversized_rows(spark):
    rows = [("t", "a", "x" * 120, "P", 1), ("t", "a", "x" * 120, "P", 2), ("t", "b", "w " * 80, "Q", 1),
        ("t", "c", "short", "Q", 1), ("t", "d", " " * 200, "Q", 1), ("t", None, "y" * 200, "Q", 1), ("t", "e", None, "Q", 1)]
    df = spark.createDataFrame(rows, "field string, record_id string, body string, hierarchy_path string, piece int")
    got = split.split_oversized(df, {"t": (50, 10)}).collect()
    assert {(r.record_id, r.unbreakable) for r in got} == {("a", 1), ("b", 0)} and all(len(r.piece) <= 50 for r in got)
    assert {r.hierarchy_path for r in got if r.record_id == "b"} == {"Q"}
    assert split.split_oversized(df.limit(0), {"t": (50, 10)}).count() == 0


# leakage


def test_letters_and_digits():
    assert leakage.letters_and_digits("Ａb-Ｃ_1 ﬁ É­!") == "abc1fié" and leakage.letters_and_digits("A-b 9") == "ab9"


@pytest.mark.parametrize("inline", [10_000_000, 0])
def test_leaks_match_brute_force(spark, monkeypatch, inline):
    from quillspan.operators import skew

    r = random.Random(11)
    items = [(i, prose(r, 40)) for i in range(8)] + [(8, "short"), (9, None), (None, prose(r, 40))]
    docs = []
    for d in range(60):
        text = prose(r, 30)
        if d % 3 == 0:
            src = leakage.letters_and_digits(items[d % 8][1])
            n = r.choice([39, 40, 41, 60])
            at = r.randrange(len(src) - n)
            text += " " + "-".join(src[at : at + n].upper()) + " " + prose(r, 30)
        docs.append((d, text))
    docs += [(100, None), (101, ""), (None, items[0][1])]
    norm = leakage.letters_and_digits
    want = set()
    for d, t in docs:
        for i, x in items:
            if d is not None and i is not None and t and x:
                a, b = norm(t), norm(x)
                if any(b[j : j + 40] in a for j in range(len(b) - 39)):
                    want.add((d, i))
    D = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    E = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = leakage.find_leaks(D, E, "doc_id", "text", "item_id", "text", shared=40, inline_chars=inline).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.length >= 40 for r in got) and len(got) == len(want)
    assert leakage.find_leaks(D, E.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    if not inline:
        monkeypatch.setattr(skew, "LOCAL", 1)
        given = [df.where(f"{k} is not null and text is not null").select(k, F.col("text").alias(t)) for df, k, t in ((D, "doc_id", "doc_text"), (E, "item_id", "item_text"))]
        split = leakage._joined(*given, 20, 21, 40, heavy=2)
        assert {(r.doc_id, r.item_id) for r in split.collect()} >= want


# shared spans


def brute_spans(rows, span):
    at = {}
    for kind, rid, t in set(rows):
        if rid is None or not t or not t.strip():
            continue
        for i in range(len(t) - span + 1):
            at.setdefault((kind, t[i : i + span]), set()).add((rid, i))
    cover = {}
    for (kind, _), places in at.items():
        if len({r for r, _ in places}) > 1:
            for rid, i in places:
                cover.setdefault((kind, rid), set()).update(range(i, i + span))
    return {k: len(v) for k, v in cover.items()}


@pytest.mark.parametrize("hot,heavy", [(64, 4096), (2, 4096), (1, 3), (64, 3)])
def test_shared_spans_match_brute_force(spark, monkeypatch, hot, heavy):
    from quillspan.operators import skew

    monkeypatch.setattr(skew, "LOCAL", 1)
    r = random.Random(7)
    passage = [prose(r, 20)[:n] for n in (60, 59, 80, 61)]
    rows = [("chunk", f"c{i}", prose(r, 15) + passage[i % 4] + prose(r, 12)) for i in range(24)]
    rows += [("block", f"b{i}", prose(r, 15) + passage[2]) for i in range(2)] + [("block", "b9", rows[0][2])]
    rows += [("chunk", "copy1", rows[3][2]), ("chunk", "copy1", rows[3][2]), ("chunk", "long", "=" * 300),
        ("chunk", "run", "ab" + "=" * 90 + "cd"), ("chunk", None, rows[0][2]), ("chunk", "e", None), ("chunk", "blank", " " * 100),
            ("chunk", "blank2", " " * 100)]
    df = spark.createDataFrame(rows, "kind string, record_id string, body string").withColumn("rid", F.lit("clash"))
    s = shared_spans.SharedSpans(df, span=60, k=16, w=30, hot_seed=hot, heavy=heavy)
    got = {(x.kind, x.record_id): x.shared_chars for x in s.coverage().collect()}
    assert got == brute_spans(rows, 60)
    held = {}
    for x in s.spans().collect():
        held[x.kind, x.record_id] = held.get((x.kind, x.record_id), 0) + x.stop - x.start
    assert held == got


def test_shared_spans_that_leave_runs_of_unequal_length(spark):
    r, rows = random.Random(3), []
    for i in range(120):
        tail = "".join(r.choice("abcdefghijklmnop") for _ in range(4 + i % 12))
        run, kind = r.choice("-=. *_#~") * (60 - len(tail)), f"k{i}"
        rows += [(kind, "a", prose(r, 15) + "|" + run + run[:4] + tail + "!" + prose(r, 12)), (kind, "b", prose(r, 15) + ":" + run + tail + "?" + prose(r, 12))]
    df = spark.createDataFrame(rows, "kind string, record_id string, body string")
    got = {(x.kind, x.record_id): x.shared_chars for x in shared_spans.SharedSpans(df, span=60, k=16, w=30).coverage().collect()}
    assert got == brute_spans(rows, 60)


def test_chains_are_collinear_and_best():
    anchors = [(0, 100), (20, 120), (40, 140), (41, 10), (60, 170), (80, 5)]
    best = shared_spans.chains(anchors, 16)[0][1]
    assert best == [(0, 100), (20, 120), (40, 140), (60, 170)]
    r = random.Random(1)
    for _ in range(30):
        a = [(r.randrange(60), r.randrange(60)) for _ in range(12)]
        score = {}
        for p, q in sorted(set(a)):  # quadratic form of the same recurrence
            score[p, q] = max([10.0] + [s + 10 - 0.02 * (p - x + q - y) for (x, y), s in score.items() if x < p and y < q])
        found = shared_spans.chains(a, 10)
        assert abs(found[0][0] - max(score.values())) < 1e-9 and sorted(x for _, c in found for x in c) == sorted(set(a))


def test_fuzzy_passages(spark):
    r = random.Random(2)
    base = prose(r, 120)
    edited = base[:300] + "XX" + base[303:]
    df = spark.createDataFrame([("k", "a", base), ("k", "b", edited)], "kind string, record_id string, body string")
    p = shared_spans.SharedSpans(df, span=100, k=20, w=30).passages().collect()
    assert len(p) == 1 and p[0].identity > 0.98 and p[0].a_stop - p[0].a_start > 700


@pytest.mark.parametrize("hot,heavy,block", [(64, 4096, 1024), (1, 4096, 4), (1, 3, 4)])
def test_fuzzy_passages_of_seeds_that_many_texts_have(spark, monkeypatch, hot, heavy, block):
    from quillspan.operators import skew

    monkeypatch.setattr(skew, "LOCAL", 1)
    monkeypatch.setattr(shared_spans, "BLOCK", block)
    r = random.Random(6)
    licence, rows = prose(r, 60), []
    for i in range(14):
        at = 20 * (i + 1)
        rows.append(("k", f"r{i:02d}", prose(r, 30) + licence[:at] + f"<{i}>" + licence[at:] + prose(r, 30)))
    rows += [("k", "z1", "+-" * 90 + prose(r, 30)), ("k", "z2", prose(r, 30) + "+-" * 80), ("other", "r00", rows[0][2]), ("k", "alone", prose(r, 90))]
    df = spark.createDataFrame(rows, "kind string, record_id string, body string")
    rows = [tuple(x) for x in shared_spans.SharedSpans(df, span=100, k=20, w=30, hot_seed=hot, heavy=heavy).passages().collect()]
    want = [tuple(x) for x in shared_spans.SharedSpans(df, span=100, k=20, w=30, hot_seed=10**9).passages().collect()]
    assert sorted(rows) == sorted(want)
    names = [f"r{i:02d}" for i in range(14)]
    assert {(x[1], x[2]) for x in rows} == {(a, b) for a in names for b in names if a < b} | {("z1", "z2")}
    assert all(x[8] > 0.95 for x in rows if x[1] != "z1" and x[7] > 400)


def test_chains_of_repeated_seeds_in_arrays(monkeypatch):
    r = random.Random(8)
    for n in (1, 2, 9, 40):
        for _ in range(20):
            places = [(r.randrange(n), r.randrange(n)) for _ in range(n * n // 2 + 1)] + [(p, q) for p in range(100, 100 + 2 * n, 2) for q in range(50, 50 + n, 2)]
            monkeypatch.setattr(shared_spans, "MANY", 10**9)
            want = shared_spans.chains(places, 5, 0.5)
            monkeypatch.setattr(shared_spans, "MANY", 1)
            monkeypatch.setattr(shared_spans, "FILL", 10**9)
            assert shared_spans.chains(places, 5, 0.5) == want


# near-duplicates


def brute_pairs(rows, threshold=0.8, least=20):
    bags = {i: Counter(near_dup.words(t)) for i, t in rows if i is not None and t}
    bags = {i: c for i, c in bags.items() if c.total() >= least}
    return {(a, b) for a in bags for b in bags if a < b and (bags[a] & bags[b]).total() >= threshold * max(bags[a].total(), bags[b].total()) - 1e-9}


def listed(rows, near=32):
    """The pairs that are listed of all pairs: of the copies of one text the next ones by id, of different texts the first copies."""
    body = {i: t for i, t in rows if i is not None and t is not None}
    nth = {i: sum(body[j] == body[i] and j <= i for j in body) for i in body}
    ok = lambda a, b: nth[b] - nth[a] <= near if body[a] == body[b] else max(nth[a], nth[b]) <= near + 1
    return {(a, b) for a, b in brute_pairs(rows) if ok(a, b)}


@pytest.mark.parametrize("bucket", [512, 1])
def test_near_duplicates(spark, monkeypatch, bucket):
    from quillspan.operators import skew

    monkeypatch.setattr(skew, "LOCAL", 1)
    r = random.Random(9)
    rows = []
    for g in range(25):
        words = prose(r, 40).split()
        rows.append((f"g{g}-0", " ".join(words)))
        for v in range(1, 4):
            w = list(words)
            for _ in range(r.randrange(6)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            r.shuffle(w)
            rows.append((f"g{g}-{v}", ", ".join(w).upper()))
    rows += [("copy", rows[0][1]), ("copy", rows[0][1]), ("short", "one two"), ("none", None), (None, rows[0][1]), ("blank", "  ")]
    df = spark.createDataFrame(rows, "id string, body string").withColumn("item", F.lit("clash"))
    n = near_dup.NearDuplicates(df, "id", "body", bucket=bucket)
    want, got = brute_pairs(rows), {(x.a, x.b) for x in n.pairs().collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert {(x.a, x.b) for x in n.pairs(next_copies=1).collect()} == listed(rows, 1) & got
    groups = {x.item: x.group_id for x in n.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in got)
    empty = near_dup.NearDuplicates(df.limit(0), "id", "body")
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_large_classes_of_different_texts_are_paired_in_full(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LIST_BLOCK", 16)
    r = random.Random(21)
    base = prose(r, 40).split()
    near = ["other", *base[1:]]
    rows = [(f"s{i:02d}", " ".join(r.sample(base, 40)) + "!" * (i % 2)) for i in range(40)] + [(f"t{i}", " ".join(r.sample(near, 40))) for i in range(10)]
    texts = list(rows)
    rows += [(f"x{i:02d}", rows[0][1]) for i in range(40)] + [(f"y{i}", rows[1][1]) for i in range(3)] + [("y0", rows[1][1])]
    df = spark.createDataFrame(rows, "id string, body string")
    n = near_dup.NearDuplicates(df, "id", "body")
    got = [(x.a, x.b) for x in n.pairs().collect()]
    want = listed(rows)
    assert len(got) == len(set(got)) and set(got) == want and brute_pairs(texts) <= set(got) and len(want) < len(brute_pairs(rows))


def test_a_band_key_of_half_of_all_rows_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 64)
    r = random.Random(4)
    base = prose(r, 60).split()
    rows = [(f"h{i:03d}", " ".join(base + [f"own{i}"])) for i in range(300)] + [(f"o{i:03d}", prose(r, 60)) for i in range(300)]
    n = near_dup.NearDuplicates(spark.createDataFrame(rows, "id string, body string"), "id", "body", bucket=100)
    assert {(x.a, x.b) for x in n.links.collect()} == {(f"h{i:03d}", f"h{j:03d}") for i in range(300) for j in range(i + 1, 300)}


def test_words():
    assert near_dup.words("It's A_b 3.5x") == ["it", "s", "a", "b", "3", "5x"] and near_dup.words("Ünïc öde_x") == ["ünïc", "öde", "x"]


# mixing


def test_water_fill():
    got = mixing.water_fill({"a": 100, "b": 10, "c": 1000}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 1}, 400)
    assert got["a"] == 100 and got["b"] == 20 and abs(got["c"] - 280) < 1e-9
    assert mixing.water_fill({"a": 5}, {"a": 1.0, "z": 0.0}, {"a": 1, "z": 3}, 100) == {"a": 5.0, "z": 0.0}


def test_mix(spark):
    r = random.Random(4)
    docs = [(i, r.choice(["a", "b", "b", "b"]), r.randrange(1, 50)) for i in range(3000)] + [(9999, "other", 70)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([(" A ", 0.5, 3), ("b", 0.4, 1), ("ghost", 0.1, 9), (None, 0.2, 1)], "source string, target_share double, max_repeat int")
    plan = mixing.mix_plan(d, t)
    rows = {x.source: x for x in plan.collect()}
    total = sum(n for *_, n in docs)
    have = Counter()
    for _, s, n in docs:
        have[s] += n
    assert rows["ghost"].below_target and not rows["b"].below_target and rows["a"].below_target == (have["a"] * 3 < 0.5 * total)
    drawn = mixing.draw_mix(d, plan, "doc_id")
    share = {x.source: x for x in mixing.reached_shares(drawn, plan).collect()}
    for s in ("a", "b"):
        assert abs(share[s].drawn_tokens - rows[s].mix_tokens) <= 50
    copies = {x.copies for x in drawn.where("source = 'a'").collect()}
    assert max(copies) <= 3 and drawn.groupBy("doc_id").count().where("count > 1").count() == 0
    assert {tuple(x) for x in drawn.collect()} == {tuple(x) for x in mixing.draw_mix(d.repartition(3), plan, "doc_id").collect()}


def test_token_counts(spark):
    import os

    if not os.path.exists(mixing.TOKENIZER):
        pytest.skip("no tokenizer here")
    df = spark.createDataFrame([(1, "Hello world, again.", "s"), (2, "", "s"), (3, None, "s")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in mixing.count_tokens(df, "text", ["doc_id"]).collect()}
    enc = mixing.encoder(mixing.TOKENIZER)
    assert got[1] == len(enc.encode_ordinary("Hello world, again.")) and got[2] == got[3] == 0 and enc.decode(enc.encode_ordinary("Größe 3")) == "Größe 3"


# quality


def test_quality_kinds():
    sentence = "This document defines how the client is expected to store a value that has been sent by the server before it is used. "
    share = lambda t: quality.measures(t)["prose_share"]
    assert share(sentence) > 0.9 and share(sentence.upper()) > 0.9
    assert share("Wenn die Richtlinie nicht mehr gültig ist, darf der Puffer sie nicht senden und muss es sagen.") > 0.9
    assert share("- quota renewal\n- server key\n- token shard state\n" + "1) alphabet\n2) bitmap field\n") == 0
    assert share("| a | b | c |\n| 1 | 2 | 3 |\n") == 0 and share("") == share("   \n") == share(None) == 0
    assert share("DÃ©r BÃ©rÃ©ich muss dÃ©n PuffÃ©r vor dÃ©r VÃ©rbindung prÃ¼fÃ©n und es ist nicht so.") == 0
    assert share("Skip to the content of the page that is here now\n" * 30) < 0.1
    assert share("renewal tertiary authenticated segment canonical keepalive bounded rewrite stream octet recommended scheduler cookie") == 0
    m = quality.measures("A b.\n\nA b.\n\nC")
    assert m["n_lines"] == 3 and abs(m["dup_line_share"] - 1 / 3) < 1e-9 and m["dup_paragraph_share"] > 0


@pytest.mark.parametrize(
    "text",
    [
        "Il server deve verificare la sessione prima di rinnovare il nodo nella finestra indicata.",
        "Serwer musi sprawdzić sesję przed odnowieniem węzła we wskazanym oknie czasu.",
        "Сервер должен проверить сессию перед обновлением узла в указанном окне.",
        "服务器必须在更新节点之前验证会话，否则请求将被拒绝。",
        "Sunucu, düğümü yenilemeden önce oturumu doğrulamak zorundadır ve isteği reddeder.",
    ],
)
def test_prose_in_languages_that_no_rule_names(text):
    assert quality.measures(text)["prose_share"] > 0.9


def test_repetition_lowers_the_prose_share():
    one = "The server must check the session before it renews the node that was named"
    assert quality.measures(one + ".")["prose_share"] > 0.9
    for text in ((one + ". ") * 40, (one + " ") * 40, "\n".join(f"{one} as number {i} says." for i in range(40)), (one + ".\n\n") * 20):
        assert quality.measures(text)["prose_share"] < 0.3


@given(st.text(max_size=400) | st.lists(st.sampled_from(["a", "bb", "the", "x", ".", "\n", "\n\n", "1"]), max_size=200).map(" ".join))
@settings(max_examples=200, deadline=None)
def test_shares_lie_between_0_and_1(text):
    m = quality.measures(text)
    assert all(0 <= v <= 1 for k, v in m.items() if k.endswith(("share", "ratio"))), m


def test_quality_table(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (None, "y")], "doc_id long, text string").withColumn("prose_share", F.lit("clash"))
    got = quality.text_quality(df, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in got) == [1, 2] and quality.text_quality(df.limit(0), "doc_id", "text").count() == 0
