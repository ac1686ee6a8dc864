"""Training-data operators against brute force and planted cases, with nulls, empty texts, repeated rows, empty tables and extra columns."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import groups, leaks, mixing, overlap, packing, sentences, splitting, tokens, wordforms

PIECES = ["the", "a", "##b", "##c", "in", "##g", "ab", "##bc", ".", "zeta"]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(i, p) for i, p in enumerate(PIECES)], "token_id int, token string")


def cost(word):
    at, n = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if ("##" if at else "") + word[at:end] in PIECES:
                break
        else:
            return 1
        at, n = end, n + 1
    return n


def count(text):
    return sum(cost(m.group()) for m in re.finditer(r"[^\W_]+|[^\s]", (text or "").lower()))


TEXTS = ["The ab abc abbcg. xyz", "", None, "  \n", "ABC_abc", "in ining 　zeta", "é😀 the", "a" * 50, "ab " * 400]


def test_counts(spark, vocab):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "k int, text string, n_tokens string")
    got = {r.k: r.n_tokens for r in tokens.count_tokens(d, vocab).collect()}
    assert got == {i: count(t) for i, t in enumerate(TEXTS)}
    for size in (3, 7, 20):
        for t in filter(None, TEXTS):
            parts = list(tokens.independent_chunks(t, size))
            assert "".join(parts) == t and sum(map(count, parts)) == count(t)


def test_budget(spark, vocab):
    rows = [("1", " Web", "en-GB", None, "the ab"), ("1", "web ", "EN", "x", "the ab"), ("2", "web", None, None, "ab " * 50), (None, "web", "en", None, "the"), (None, "web", "en", None, "the"), ("3", None, " ", "", None)]
    d = spark.createDataFrame(rows, "id string, source string, lang string, doctype string, text string")
    for oversize in (8, 8192):
        got = {(r.source, r.lang, r.doctype): r.n_tokens for r in tokens.token_budget(d, vocab, oversize=oversize).collect()}
        assert got == {("web", "en", "unknown"): 1, ("web", "en", "x"): 2, ("web", "unknown", "unknown"): 50, ("unknown", "", ""): 0} or got == {("web", "en", "unknown"): 3, ("web", "unknown", "unknown"): 50, ("unknown", "", ""): 0}
    assert tokens.token_budget(d.limit(0), vocab).count() == 0


def check_pieces(text, spans, got, limit, overlap_):
    got = sorted(got, key=lambda r: r.piece_no)
    assert [r.piece_no for r in got] == list(range(len(got)))
    at = 0
    for r in got:
        assert r.piece == text[r.start : r.end] and count(r.piece) == r.n_tokens <= limit
        assert not text[at : r.start].strip() or r.start <= at  # nothing is left out
        if r.start < at:
            assert count(text[r.start : at]) <= overlap_
        for s in spans or []:
            assert not s[0] < r.end < s[1] or r.end == len(text.rstrip()), "a cut in a span"
            assert not s[0] < r.start < s[1] or r.start < at
        for s in r.spans or []:
            assert text[r.start + s.start : r.start + s.end] == r.piece[s.start : s.end]
        at = max(at, r.end)
    assert not text[at:].strip()


def test_split(spark, vocab):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        words = [rng.choice(["the", "ab", "abc", "in", "xyz", "The end.\n\n", "stop. ", "line\n"]) for _ in range(rng.randrange(0, 400))]
        text = " ".join(words)
        spans = sorted({(a, min(len(text), a + rng.randrange(1, 30))) for a in (rng.randrange(0, max(1, len(text))) for _ in range(4))}) if i % 3 else None
        rows.append((str(i), text, [(a, b, "PER") for a, b in spans if a < b] if spans is not None else None, 1))
    rows += [("e", "", None, 1), ("n", None, None, 1), ("w", "ab" + "b" * 300, None, 1), (None, "ab " * 100, None, 1)]
    d = spark.createDataFrame(rows + rows[:7], "id string, text string, spans array<struct<start:int,end:int,label:string>>, piece_no int")
    for range_chars, halo in ((100_000, 2048), (300, 200)):
        by = collections.defaultdict(list)
        for r in splitting.split_records(d, vocab, 32, 6, range_chars, halo).collect():
            by[r.id].append(r)
        assert set(by) == {i for i, t, _, _ in rows if count(t) > 32}
        for i, t, s, _ in rows:
            if i in by:
                check_pieces(t, [(a, b) for a, b, _ in s or []], by[i], 32, 6)
    assert splitting.split_records(d.limit(0), vocab).count() == 0


def test_split_of_sparse_and_differing_texts(spark, vocab):
    sparse, long = ("ab" + " " * 400) * 60, "The ab. " * 3000
    rows = [("sparse", sparse, None), ("word", "a" + "b" * 9000 + " ab", None), ("two", "ab " * 30, None), ("two", "zeta " + "ab " * 40, None), ("long", long, [(8190, 8260, "X")]), ("long", long, [(8190, 8260, "X")])]
    d = spark.createDataFrame(rows, "id string, text string, spans array<struct<start:int,end:int,label:string>>")
    by = collections.defaultdict(list)
    for r in splitting.split_records(d, vocab, 256, 32).collect():
        by[r.id].append(r)
    assert set(by) == {i for i, t, _ in rows if count(t) > 256} == {"long", "word"}
    check_pieces(long, [(8190, 8260)], by["long"], 256, 32)
    by = collections.defaultdict(list)
    for r in splitting.split_records(d, vocab, 20, 4).collect():
        by[r.id].append(r)
    assert set(by) == {"sparse", "word", "two", "long"} and all(r.piece in rows[3][1] for r in by["two"])
    check_pieces(rows[3][1], [], by["two"], 20, 4)
    check_pieces(sparse, [], by["sparse"], 20, 4)


def test_split_files(spark, vocab, tmp_path):
    text = "".join(f"The é😀 ab abc {i}. " + ("\n\n" if i % 7 == 0 else "") for i in range(3000))
    (tmp_path / "big.txt").write_text(text, encoding="utf8")
    (tmp_path / "none.txt").write_text("")
    got = splitting.split_files(spark, [str(tmp_path / "big.txt"), str(tmp_path / "none.txt")], vocab, 64, 8, range_bytes=5000, halo=1000).collect()
    raw, at = text.encode(), 0
    for r in sorted(got, key=lambda r: r.piece_no):
        assert raw[r.start_byte : r.end_byte].decode() == r.piece == text[r.start_char : r.start_char + len(r.piece)]
        assert count(r.piece) == r.n_tokens <= 64 and (r.start_byte <= at or not raw[at : r.start_byte].strip())
        at = max(at, r.end_byte)
    assert not raw[at:].strip() and len(got) > 50


def test_pack(spark, vocab):
    rng = random.Random(2)
    rows = [(i, "ab " * rng.randrange(0, 60), i) for i in range(600)] + [(1000, "the " * 205, 0), (1001, None, 0), (1002, " ", 0), (1003, "x" * 9, 0), (1004, "a" + "b" * 250, 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, container_id int")
    for per in (3, 1_000_000):
        got = packing.pack(d, vocab, 64, per_bucket=per).collect()
        fill, docs = collections.Counter(), collections.defaultdict(list)
        for r in got:
            fill[r.container_id] += r.n_tokens
            docs[r.doc_id].append(r)
        assert max(fill.values()) <= 64 and set(docs) == {r[0] for r in rows}
        assert sum(fill.values()) == sum(r.n_tokens for r in got)
        for i, t, _ in rows:
            n = count(t)
            assert (len(docs[i]) > 1) == (n > 64) and (n > 64 or docs[i][0].n_tokens == n)
            assert "".join((t or "")[r.start_char : r.end_char].strip() + " " for r in sorted(docs[i], key=lambda r: r.piece_no)).split() == (t or "").split() or i == 1004
        bins = []  # first fit by falling size
        for n in sorted((r.n_tokens for r in got if r.n_tokens), reverse=True):
            k = next((k for k, used in enumerate(bins) if used + n <= 64), None)
            bins = [*bins, n] if k is None else [*bins[:k], bins[k] + n, *bins[k + 1 :]]
        assert len([c for c in fill if fill[c]]) <= len(bins)
    assert packing.pack(d.limit(0), vocab, 64).count() == 0


def test_filling_is_best():
    import itertools

    rng = random.Random(1)
    for _ in range(60):
        lengths = [rng.randrange(1, 20) for _ in range(8)]
        left = dict(collections.Counter(lengths))
        used = packing.filling(left, 25)
        top = max(lengths)
        rest = list(lengths)
        rest.remove(top)
        best = max(top + sum(c) for k in range(8) for c in itertools.combinations(rest, k) if top + sum(c) <= 25)
        assert sum(n * k for n, k in used.items()) == best and all(k <= left[n] for n, k in used.items()) and top in used


def test_mix(spark, vocab):
    rows = [(i, "ab " * (i % 7 + 1), ["Web", "mail ", "rare"][0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]) for i in range(2000)] + [(9001, "ab", None), (9002, None, "web"), (9003, "ab", "other")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("web", 0.5, 1), ("MAIL", 0.2, 2), ("rare", 0.3, 2), ("gone", 0.01, 3)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t, vocab, shards=8, blocks=128)
    shares = {r.source: r for r in m.shares.collect()}
    total = sum(count(x) for _, x, s in rows if s)
    assert {s for s, r in shares.items() if r.short} == {"rare", "gone"}
    out = m.rows.collect()
    by, uses = collections.Counter(), collections.Counter((r.doc_id, r.pass_no) for r in out)
    for r in out:
        by[r.source] += r.n_tokens
    assert max(uses.values()) == 1 and max(collections.Counter(r.doc_id for r in out).values()) <= 2
    assert all(by[s] == r.mixed_tokens for s, r in shares.items()) and abs(by["web"] - 0.5 * total) < 0.02 * total
    assert by["rare"] == 2 * sum(count(x) for _, x, s in rows if s == "rare")
    sizes = collections.Counter(r.shard for r in out)
    assert len(sizes) == 8
    assert mixing.mix(d.limit(0), t, vocab).rows.count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(150)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)] + [("x", None), (None, None), ("y", "y")]
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = a or b, b or a
        if a:
            lo, hi = sorted((find(a), find(b)))
            par[hi] = lo
    got = {r.node: r.label for r in groups.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in par}
    assert groups.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_groups(spark):
    f = spark.createDataFrame([("T-GB-a-01", "template", "GB", "a", 1, "Bo Li", None, 0), ("T-GB-a-02", "template", "GB", "a", 2, " LI,  bo", None, 0), ("D-FR-b-03", "document", "FR", "b", 3, None, "T-GB-a-02", 0), ("D-FR-b-04", "document", "FR", "b", 4, None, None, 0)],
        "file_id string, source string, country string, doctype string, file_no int, author string, adapted_from string, id int")
    r = spark.createDataFrame([("tpl-en-GB-a-02-00000001", "template", "GB", "a", None), ("doc-fr-FR-03-00000002", "x", None, " B", None), ("x-FR-b-004-00000003", "DOCUMENT ", "FR", None, None), ("reg-fr-FR-2024-00000007-1", "registry", "FR", None, "QX 1"), ("reg-fr-fr-24/7-02", "registry", "FR", None, None), ("reg-es-ES-2020_1.1", "registry", None, None, "qx-1"), ("odd", None, None, None, None), (None, None, None, None, None)],
        "id string, source string, country string, doctype string, origin string")
    got = {x.id: x.group_id for x in groups.related_groups(r.union(r), f).collect()}
    assert got == {"tpl-en-GB-a-02-00000001": "D-FR-b-03", "doc-fr-FR-03-00000002": "D-FR-b-03", "x-FR-b-004-00000003": "D-FR-b-04", "reg-fr-FR-2024-00000007-1": "reg-es-ES-2020_1.1", "reg-fr-fr-24/7-02": "reg-es-ES-2020_1.1", "reg-es-ES-2020_1.1": "reg-es-ES-2020_1.1", "odd": "odd"}
    g = spark.range(5000).select(F.concat(F.lit("g"), (F.col("id") % 700).cast("string")).alias("group_id"), F.col("id").cast("string").alias("id"))
    s = groups.assign_splits(g, g.select("id", (F.col("id").cast("int") % 3).cast("string").alias("label")), {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(s) == 5000 and len({(x.group_id, x.split) for x in s}) == 700
    n = collections.Counter(x.split for x in s)
    assert abs(n["train"] - 4000) < 60 and abs(n["test"] - 500) < 40


def test_splits_with_more_labels_than_are_told_apart(spark):
    g = spark.range(3000).select(F.concat(F.lit("g"), (F.col("id") % 1500).cast("string")).alias("group_id"), F.col("id").cast("string").alias("id"))
    labels = g.select("id", F.when(F.col("id").cast("int") % 5 > 0, (F.col("id").cast("int") % 300).cast("string")).alias("label"))
    s = groups.assign_splits(g, labels, {"train": 0.8, "validation": 0.1, "test": 0.1}, told_apart=20).collect()
    n = collections.Counter(x.split for x in s)
    assert len(s) == 3000 and len({(x.group_id, x.split) for x in s}) == 1500 and abs(n["train"] - 2400) < 40
    assert groups.assign_splits(g.limit(0), labels, {"train": 1.0}).count() == 0


def words_of(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(8)
    item = words_of(rng, 120)
    hit = item[20:60]
    noisy = [w if k % 7 else "zz" for k, w in enumerate(item[10:60])]
    two = item[:18] + words_of(rng, 40) + item[70:90]
    late = words_of(rng, 30)
    rows = {
        "exact": " ".join(words_of(rng, 50) + hit), "noisy": " ".join(noisy), "two": " ".join(two), "caps": "\n".join(hit).upper().replace("W1", "W&#49;"), "cyr": " ".join(hit).replace("w", "​w"),
        "short": " ".join(item[20:42] + late), "shuffled": " ".join(rng.sample(hit, len(hit))), "other": " ".join(words_of(rng, 200)), "empty": "", "null": None,
    }
    d = spark.createDataFrame([*rows.items(), *list(rows.items())[:3], (None, " ".join(hit))], "id string, text string").withColumn("case_id", F.lit("x"))
    t = spark.createDataFrame([("c1", " ".join(item)), ("c2", " ".join(words_of(rng, 60))), ("c3", None), (None, " ".join(item)), ("c4", "short one")], "case_id string, text string")
    exp = {("c1", k) for k in ("exact", "noisy", "two", "caps", "cyr")}
    for block in (200_000, 40):
        assert {tuple(r) for r in leaks.leaks(d, t, block_words=block).collect()} == exp
    assert leaks.leaks(d.limit(0), t).count() == 0 and leaks.leaks(d, t.limit(0)).count() == 0


def leaked(item, *records):
    return {d for d, _ in leaks.Items([("c", " ".join(item))], 30, 6).pairs([" ".join(r) for r in records])}


def test_leaks_with_near_edits():
    rng = random.Random(12)
    item = [f"w{k}" for k in range(80)]
    noise = [f"w{k}" for k in range(1000, 1030)]
    near = [w if k not in (3, 10, 12, 17, 24) else f"z{k}" for k, w in enumerate(item[20:50])]
    long = [w if k not in (3, 10, 12, 17, 24, 33, 40, 42, 47, 54) else f"z{k}" for k, w in enumerate(item[10:70])]
    assert leaked(item, noise + near + noise, long, item[20:45] + noise, item[20:49], [*item[20:49], "x", *noise]) == {0, 1}
    for _ in range(60):  # any five edits in 30 words but for those at the ends
        edits = set(rng.sample(range(1, 29), 5))
        x = [y for k, w in enumerate(item[20:50]) for y in (rng.choice([[], ["x"], ["x", w]]) if k in edits else [w])]
        assert leaked(item, noise + x + noise) == {0}


def passage(rng, item, size, edits, stretches):
    """A record with so many words of the item in one or two stretches, edited at random but at their ends."""
    noise = lambda n: [f"n{rng.randrange(400)}" for _ in range(n)]
    first = rng.randrange(8, size - 7) if stretches == 2 else size
    at = rng.randrange(0, len(item) - size - 25)
    cuts = [item[at : at + first], item[at + first + 9 : at + 9 + size]]
    free = [k for k in range(1, size - 1) if k not in (first - 1, first)]
    chosen, out, k = set(rng.sample(free, edits)), noise(30), 0
    for part in cuts:
        for w in part:
            out += rng.choice([[], ["x"], ["x", w]]) if k in chosen else [w]
            k += 1
        out += noise(rng.randrange(5, 40))
    return out


def test_leaks_at_the_limit():
    rng = random.Random(13)
    item = [f"w{k}" for k in range(120)]
    index = leaks.Items([("c", " ".join(item))], 30, 6)
    found, made = collections.Counter(), collections.Counter()
    for stretches in (1, 2):
        for size, edits in ((30, 1), (30, 2), (30, 3), (30, 4), (30, 5), (36, 4), (36, 6), (42, 5), (42, 7), (48, 8), (60, 10)):
            for _ in range(60):
                made[stretches] += 1
                found[stretches] += bool(index.pairs([" ".join(passage(rng, item, size, edits, stretches))]))
    assert found[1] == made[1] and found[2] >= 0.99 * made[2]
    less = [" ".join(passage(rng, item, 24, 0, k)) for k in (1, 2) for _ in range(100)]
    assert not index.pairs(less) and not index.pairs([" ".join(rng.sample(item[20:70], 50)) for _ in range(100)])


def test_leaks_with_a_short_stretch():
    item = [f"w{k}" for k in range(80)]
    noise = [f"w{k}" for k in range(1000, 1030)]
    two = [w if k not in (3, 7) else f"z{k}" for k, w in enumerate(item[60:70])]
    records = [item[:22] + noise + item[50:58], item[:20] + noise + two, item[50:58] + noise + item[:22], item[:22] + noise + item[50:57], item[30:35] + noise + item[40:65]]
    assert leaked(item, *records) == {0, 1, 4}


def test_myers_is_the_edit_distance():
    rng = random.Random(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        assert leaks.myers(a, b) == plain(a, b)


def test_overlap_matches_brute_force(spark):
    rng = random.Random(6)
    base = [words_of(rng, rng.randrange(1, 120)) for _ in range(60)]
    train, ev = [], []
    for i, w in enumerate(base):
        train.append(("s", f"t{i}", " ".join(w)))
        for rate in (0.0, 0.05, 0.12, 0.2):
            x = [y for v in w for y in ([] if rng.random() < rate / 2 else ["q"] if rng.random() < rate / 2 else [v])]
            ev.append(("s", f"e{i}-{rate}", "  ".join(x).upper() + "!"))
    ev += [("s", "z", None), ("s", "y", ""), ("r", "other scope", " ".join(base[0])), ("s", None, "w1"), ("s", "han", "合同双方提交了押金收据今天"), ev[0]]
    train += [("s", "copy", " ".join(base[0])), ("s", "han", "合同双方提交了押金收据"), ("s", "n", None), train[5]]
    f = wordforms.Forms()
    words = lambda t: f.words(t, True)
    exp = set()
    for s, e, t in ev:
        for s2, k, u in train:
            a, b = words(t), words(u)
            if s == s2 and e and a and b and overlap.lcs(a, b) >= 0.85 * max(len(a), len(b)):
                exp.add((s, e, k))
    schema = "scope string, id string, text string"
    got = {tuple(r) for r in overlap.overlaps(spark.createDataFrame(ev, schema), spark.createDataFrame(train, schema)).collect()}
    assert got == exp and len(exp) > 100
    assert overlap.overlaps(spark.createDataFrame([], schema), spark.createDataFrame(train, schema)).count() == 0


def test_overlap_of_drops_and_adds_apart(spark):
    rng = random.Random(9)
    train, ev = [("s", "a", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13")], [("s", "a", "w1 w2 w4 w5 w6 X w7 w8 w9 w10 Y w11 w12 w13")]
    for n in [*range(6, 60), 80, 120, 150] * 2:
        w = words_of(rng, n) if len(train) % 5 else [f"w{rng.randrange(4)}" for _ in range(n)]  # some texts repeat few words
        edits = int(0.15 * n)
        at = rng.sample(range(n), min(n, 2 * edits))
        drops, adds = set(at[:edits]), set(at[edits:])
        x = [y for k, v in enumerate(w) for y in ([] if k in drops else ["q", v] if k in adds else [v])]
        train.append(("s", f"t{len(train)}", " ".join(w)))
        ev.append(("s", f"e{len(ev)}", " ".join(x)))
        # every fourth word or so is changed on one side by turns, evenly apart
        step, x = max(1, n // max(1, 2 * edits)), []
        for k, v in enumerate(w):
            turn = k // step if k % step == step // 2 and k // step < 2 * edits else None
            x += [v] if turn is None else [] if turn % 2 else ["q", v]
        ev.append(("s", f"e{len(ev)}", " ".join(x)))
    schema = "scope string, id string, text string"
    for share in (0.85, 0.7):
        exp = {("s", e, k) for _, e, t in ev for _, k, u in train if overlap.lcs(t.lower().split(), u.split()) >= share * max(len(t.split()), len(u.split()))}
        got = {tuple(r) for r in overlap.overlaps(spark.createDataFrame(ev, schema), spark.createDataFrame(train, schema), share).collect()}
        assert got == exp and len(exp) > 200


def test_kept_runs_in_common_are_never_fewer_than_said():
    rng, np = random.Random(10), overlap.np
    often = np.array([rng.randrange(9) for _ in range(1 << overlap.SLOTS)])
    seen = 0
    for share in (0.85, 0.7, 0.55):
        shape = overlap.Shape(share)
        for _ in range(400):
            a = [rng.randrange(rng.choice([3, 50, 500])) for _ in range(rng.randrange(2, 120))]
            b = [y for v in a for y in rng.choices([[v], [], [999, v]], [share * 20, 1, 1])[0]]
            if a == b or not b or overlap.lcs(a, b) < share * max(len(a), len(b)):
                continue
            (ga, _, pa), (gb, _, pb) = (overlap.kept_runs(np.array(x, dtype=np.uint64), np.array([len(x)]), often, shape) for x in (a, b))
            need = min(int(p[0]) >> overlap.PLACE & 0xFFF for p in (pa, pb))
            assert len(set(ga) & set(gb)) >= need > 0
            spots = set(overlap.eval_spots(ga, pa, shape))
            there = [g for g, p in zip(gb, pb) if g in set(ga) and {int(overlap.spots(gb[:1] * 0 + g, k, c)[0]) for k, c in looked_up(overlap, shape, p)} & spots]
            assert len(there) >= need
            seen += 1
    assert seen > 300


def test_groups_in_common_are_never_fewer_than_said():
    rng, np = random.Random(12), overlap.np
    often = np.array([rng.randrange(9) for _ in range(1 << overlap.SLOTS)])
    seen = 0
    for share in (0.85, 0.8, 1.0):
        shape = overlap.Shape(share)
        for _ in range(400):
            a = [rng.randrange(rng.choice([3, 50, 500])) for _ in range(rng.randrange(1, 200))]
            b = [y for v in a for y in rng.choices([[v], [], [999, v]], [share * 20, 1, 1])[0]] if share < 1 else a[:]
            if not b or overlap.lcs(a, b) < share * max(len(a), len(b)):
                continue
            rng.shuffle(b)  # the order doesn't count
            words = [(np.array(x, dtype=np.uint64), np.array([len(x)])) for x in (a, b)]
            g, _ = overlap.eval_groups(*words[0], often, shape)
            looked, _, need = overlap.train_groups(*words[1], shape)
            assert len(set(g) & set(looked)) >= need[0] > 0
            seen += 1
    assert seen > 500


def shuffled(spark):
    """Bytes written to shuffle files so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_overlap_shuffles_in_proportion(spark):
    """Texts of one set of phrases share runs with ever more others; what is shuffled follows the texts, not the pairs."""
    rng = random.Random(13)
    phrases = [" ".join(f"w{rng.randrange(400)}" for _ in range(4)) for _ in range(60)]
    schema, written = "scope string, id string, text string", []
    for n in (100, 1000):
        train, ev = ([("s", f"{i}", " ".join(rng.choices(phrases, k=50))) for i in range(n)] for _ in range(2))
        ev.append(("s", "near", "other words " + train[0][2]))
        before = shuffled(spark)
        got = overlap.overlaps(spark.createDataFrame(ev, schema), spark.createDataFrame(train, schema)).collect()
        assert [tuple(r) for r in got] == [("s", "near", "0")]
        written.append(shuffled(spark) - before)
    assert written[1] < 12 * written[0], written
    assert written[1] < 5000 * 1000, written


def looked_up(o, shape, p):
    """Classes and cells under which a training run is looked up."""
    n, place = o.np.array([p >> o.PLACE + 12]), int(p) & (1 << o.PLACE) - 1
    kind = shape.kind(n)
    return [(kind, o.np.array([place // int(shape.step(kind)[0]) if place else -1])), (kind, o.np.array([-2]))]


def spoiled(rng, w, edits, how):
    """A text with so many words substituted, dropped and added elsewhere, or moved."""
    at = rng.sample(range(len(w)), 2 * edits)
    drop, add = set(at[:edits]), set(at[edits:])
    if how == "substituted":
        return [f"q{k}" if k in drop else v for k, v in enumerate(w)]
    out = [y for k, v in enumerate(w) for y in ([] if k in drop else [f"q{k}", v] if k in add else [v])]
    if how == "moved":
        moved = iter(rng.sample([w[k] for k in sorted(drop)], edits))
        out = [next(moved) if v.startswith("q") else v for v in out]
    return out


def test_overlap_at_the_limit(spark):
    rng = random.Random(11)
    train, ev, exp = [], [], set()
    for n, edits in ((20, 3), (40, 6), (100, 15)):
        for how in ("substituted", "dropped and added", "moved"):
            for i in range(200):
                w = [f"w{rng.randrange(300)}" for _ in range(n)]
                name = f"{n} {how} {i}"
                train.append(("s", name, " ".join(w)))
                ev.append(("s", name, " ".join(spoiled(rng, w, edits, how))))
                exp.add(name)
    schema = "scope string, id string, text string"
    got = overlap.overlaps(spark.createDataFrame(ev, schema), spark.createDataFrame(train, schema)).collect()
    assert {r.eval_id for r in got if r.eval_id == r.train_id} == exp and len(exp) == 1800


SENTENCES = [
    ("A\ue000b c. D\ue00fe f\ue001. G\ue003h\ue00e i. J\ue002k.", ["A\ue000b c.", "D\ue00fe f\ue001.", "G\ue003h\ue00e i.", "J\ue002k."]),
    ("كيف الحال؟ أنا بخير. نعم", ["كيف الحال؟", "أنا بخير.", "نعم"]),
    ("یہ ہے۔ وہ ہے۔", ["یہ ہے۔", "وہ ہے۔"]),
    ("Ես եմ։ Դու ես։ ሰላም ነው። ደህና።", ["Ես եմ։", "Դու ես։", "ሰላም ነው።", "ደህና።"]),
    ("We met Sen. Smith today. Fine.", ["We met Sen. Smith today.", "Fine."]),
    ("See Dr. Fox at 9.30 a.m. today. He left at 5 p.m. Then J. R. Bell came, i.e. late.", ["See Dr. Fox at 9.30 a.m. today.", "He left at 5 p.m.", "Then J. R. Bell came, i.e. late."]),
    ("Title\n\nDear Ann,\n\n1. First item;\n- second\n“Go!” said Ann. (All of it.) Why?!", ["Title", "Dear Ann,", "1. First item;", "- second", "“Go!” said Ann.", "(All of it.)", "Why?!"]),
    ("A line that goes\non below (see fig. 5) and ends.\n\nNext", ["A line that goes\non below (see fig. 5) and ends.", "Next"]),
    ("Am 10. Mai kam Post. »Weder noch!« sagte Prof. Bach, z. B. heute. Kalt & Co. KG zahlt 1.160,50 €.", ["Am 10. Mai kam Post.", "»Weder noch!« sagte Prof. Bach, z. B. heute.", "Kalt & Co. KG zahlt 1.160,50 €."]),
    ("« Pourquoi ? » a dit M. Roux. Vers 17 h. Le reste… suit, c.-à-d. 3 €.", ["« Pourquoi ? » a dit M. Roux.", "Vers 17 h.", "Le reste… suit, c.-à-d. 3 €."]),
    ("Acme S. Coop. pagó. Vive en Sol S.L. ¿Por qué? p. ej. hoy", ["Acme S. Coop. pagó.", "Vive en Sol S.L.", "¿Por qué? p. ej. hoy"]),
    ("他说：“好！”金额为89.52万元，完了。真的……新的", ["他说：“好！”", "金额为89.52万元，完了。", "真的……", "新的"]),
    ("「はい。」と言った。次。", ["「はい。」と言った。", "次。"]),
    ("สวัสดีครับ วันนี้ที่2 ไปแล้ว", ["สวัสดีครับ", "วันนี้ที่2", "ไปแล้ว"]),
    ("यह है। राशि 17.68 है।  और?", ["यह है।", "राशि 17.68 है।", "और?"]),
    ("Mail a.b@c.example or www.x.example now.\r\n\r\nv6.1.2 is out.\xa0Good.", ["Mail a.b@c.example or www.x.example now.", "v6.1.2 is out.", "Good."]),
]


def test_sentences(spark):
    rows = [(i, t) for i, (t, _) in enumerate(SENTENCES)] + [(100, None), (101, " \n\t"), (102, ""), (103, "One. Two. " * 700)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start_char", F.lit("x"))
    by, text = collections.defaultdict(list), dict(rows)
    for r in sentences.sentence_offsets(d).orderBy("doc_id", "start_char").collect():
        by[r.doc_id].append(text[r.doc_id][r.start_char : r.end_char])
    for i, (_, exp) in enumerate(SENTENCES):
        assert by[i] == exp
    assert set(by) == {*range(len(SENTENCES)), 103} and by[103] == ["One.", "Two."] * 700
    assert sentences.sentence_offsets(d.limit(0)).count() == 0
