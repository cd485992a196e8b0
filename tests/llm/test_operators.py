import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.llm.test_brute import kept_by_pairs
from tests.llm.test_tokens import plain_best_fit

from trialforge.llm import attention, attribution, chat, decontam, extraction, langid, lm, packing, quality, simhash, urlfilter
from trialforge.llm.common import WordTokenizer, splits_parts, vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "n_words long, kept string, fp string, lang_pred int, __words int, rank int, bucket int, length int, score string, word int, host_ok int"
LONG = " ".join(f"w{i % 977} x{i % 13}." for i in range(30_000))
TEXTS = [None, "", "   \n\t", "a", "one two three", "!!! ??? 123", "Same text here, again and again.\nSame text here, again and again.", LONG, "é́ 日本語  x", "The quick brown fox jumps over the lazy dog. " * 3, "The quick brown fox jumps over the lazy dog. " * 3]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in any column, empty and long texts, repeated rows, equal ids, clashing names."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", 1) for i, t in enumerate(TEXTS)]
    rows += [(9, TEXTS[9], None, "s", None), (None, "no id at all here", "fr", None, None), (4, "another text of the same id", "en", "s", 3)]
    tail = (0,) + ("x",) * 2 + (1,) * 5 + ("x", 1, 1)
    return spark.createDataFrame([r + tail for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="module")
def none(hard):
    return hard.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def plain_fingerprint(text, k=4):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_near_duplicates_match_brute_force(docs):
    got = {r["doc_id"]: r for r in rows_of(simhash.near_duplicates(docs))}
    data = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    fps = [plain_fingerprint(t) for _, t in data]
    for (doc_id, _), fp, root in zip(data, fps, plain_components(fps), strict=True):
        assert got[doc_id]["fingerprint"] == f"{fp:016x}" and got[doc_id]["component_id"] == data[root][0]


def test_links_of_random_and_hot_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 9)), replace=False)) for _ in range(500)} | {int(x) for x in rng.integers(0, 1 << 63, 300)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for blocks, page in ((6, 1024), (6, 40), (7, 64)):  # small pages split the hot group
        roots = {r.node: r.root for r in simhash.fingerprint_components(df, 4, blocks, page).collect()}
        want = plain_components(fps)
        same = lambda label: {frozenset(i for i in range(len(fps)) if label[i] == x) for x in set(label)}
        assert same([roots.get(s, s) for s in signed]) == same(want)


def test_bk_tree_follows_only_near_edges():
    rng = np.random.default_rng(2)
    items = [int(x) for x in rng.integers(0, 1 << 12, 400)]
    tree = simhash.BKTree()
    for x in items:
        tree.add(x)
    assert sorted(tree.items) == sorted(set(items))
    for q in range(0, 4096, 37):
        assert sorted(tree.items[i] for i in tree.within(q, 2)) == sorted(x for x in set(items) if (x ^ q).bit_count() <= 2)


def test_near_duplicates_of_hard_rows(hard, none):
    got = rows_of(simhash.near_duplicates(hard))
    assert len(got) == hard.count() and {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {0}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns and kept.where("doc_id in (0, 9)").count() == 2 and kept.where("doc_id in (1, 2, 10)").count() == 0
    assert simhash.keep_one(none).count() == 0


def test_keep_one_keeps_a_row_of_each_group(spark):
    a, b, c, d = ("alpha beta gamma delta epsilon " * 9, "one two three four five six " * 9, "red green blue white black grey " * 9, "north south east west up down " * 9)
    rows = [(None, a, 1), (None, b, 2), (None, a, 3), (7, c, 4), (7, d, 5), (7, d, 6), (8, d, 7), (None, c, 8)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3))
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == sorted([(0, a), (0, b), (7, c), (7, d)])


def test_language_of_held_out_documents(docs, hard, none):
    got = {r["doc_id"]: r for r in rows_of(langid.identify(docs))}
    held = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id]["held_out"] for r in held) and np.mean([got[r.doc_id]["lang_pred"] == r.lang for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    rows = {r["doc_id"]: r["lang_pred"] for r in rows_of(langid.identify(hard))}
    assert rows[0] == rows[1] == rows[2] == rows[5] == "und" and rows[9] != "und"
    assert langid.identify(none).count() == 0 and langid.keep_identified(none).count() == 0
    assert {r.lang_pred for r in langid.identify(hard.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_codewords():
    for n in (2, 3, 4, 5, 6, 40):
        c = langid.codewords(n)
        assert c.shape[0] == n and len(np.unique(c, axis=0)) == n and (np.abs(c.sum(0)) < n).all()


def plain_measures(text):
    w = WORD.findall(text or "")
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@pytest.mark.parametrize("which", ["docs", "hard"])
def test_quality_measures(which, request):
    df = request.getfixturevalue(which)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = collections.Counter((r.doc_id, *[r[n] for n in names], r.base_failed) for r in quality.judge(df).collect())
    want = collections.Counter()
    for r in df.select("doc_id", "text").collect():
        m = plain_measures(r.text)
        want[(r.doc_id, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert got == want


def test_host_verdicts(spark, none):
    good, bad = "a fine text of more than ten words that no rule has anything against", "bad"
    rows = [(i, good if i % 10 else bad, "clean") for i in range(40)] + [(100 + i, bad if i % 10 else good, "spam") for i in range(40)] + [(200, good, "new"), (201, good, None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[110].kept and not got[110].base_failed and got[1].kept and got[200].kept and got[201].kept and not got[0].kept
    kept = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept) and kept.columns == ["doc_id", "text", "source"]
    assert quality.keep_good(none).count() == 0


def test_rules_and_ranks(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    pages = [
        (0, "https://good.org/a", link("friend.net", "friend.net")), (1, "http://X.Example.org/es/1?q", link()), (2, "http://example.org/en/12", None), (3, "https://a.com/fr/", ""), (4, "https://friend.net/p", link("far.net")),
        (5, "https://far.net/p", ""), (6, "https://spam.net/p", link("example.org", "a.com")), (7, None, None), (8, "no scheme", link("b.net")), (9, "https://deep.spam.net?x#y", link("spam.net")), (9, "https://deep.spam.net?x#y", link("spam.net")), (10, "https://org", ""),
    ]
    got = {r.page_id: r for r in urlfilter.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(4)] == [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow")]
    assert got[1].host == "x.example.org" and got[1].path == "/es/1" and got[7].host == got[7].path == got[8].host == "" and got[10].rule is None and got[9].path == ""
    assert got[4].trust > got[5].trust > 0 and got[4].verdict == "allow" and got[6].verdict == "block" and got[9].verdict == "block" and got[7].verdict == "allow"
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 1.0)]
    ranks = {r.host: r.rank for r in urlfilter.personalised_rank(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a", 1.0), ("d", 3.0)], "host string, seed double"), rounds=12, tolerance=0.0).collect()}
    want, out = {"a": 0.15, "b": 0.0, "c": 0.0, "d": 0.45}, {"a": 3.0, "b": 1.0, "c": 1.0, "d": 1.0}
    for _ in range(12):
        want = {h: 0.15 * {"a": 1.0, "d": 3.0}.get(h, 0.0) + 0.85 * sum(w / out[s] * want[s] for s, t, w in edges if t == h) for h in "abcd"}
    assert all(abs(ranks[h] - want[h]) < 1e-9 for h in "abcd")
    assert urlfilter.judge_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_section_tokens(docs, hard, none):
    got = collections.Counter()
    for r in attribution.section_tokens(docs).collect():
        got[r.doc_id] += r.n_tokens
    encoding, _ = attribution.encoder(vocabulary_path("byte_bpe_50k.tiktoken"))
    assert all(got[r.doc_id] == len(encoding.encode_ordinary(r.text)) for r in docs.collect())
    rows = attribution.section_tokens(hard, ("source", "text")).collect()
    assert {(r.field, r.n_tokens) for r in rows if r.doc_id == 0} == {(0, 1), (1, 0)}
    assert attribution.section_tokens(none).count() == 0


def test_unigram_scores(docs, hard, none):
    for df in (docs, hard):
        data = [(r.doc_id, [w.lower() if w.isascii() else w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(r.text or "")] + [""]) for r in df.select("doc_id", "text").collect()]
        held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
        c = collections.Counter(w for i, t in data if not held(i) for w in t)
        n, v = sum(c.values()), len(c)
        want = sorted((str(i), held(i), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)) for i, t in data)
        got = lm.score(df, most_frequent=50, least_docs=40).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 and r.train_tokens == n for r in got)
    assert lm.score(none).count() == 0


def test_attention_is_causal_and_sums_to_one():
    rng = np.random.default_rng(0)
    w = attention.initial(np.ones(attention.CLASSES))
    s = attention.Scorer(w)
    x, y, real = attention.windows([bytes(rng.integers(0, 60, 40).tolist()) + bytes([attention.END])])
    assert real.sum() == 41
    total = sum(np.exp(s.log_probabilities(x, np.full_like(y, c))) for c in range(attention.CLASSES))
    assert np.allclose(total, 1, atol=1e-4)
    z = x.copy()
    z[:, attention.CONTEXT + 6 :] = 5  # inputs after the sixth don't count for what comes before
    assert np.allclose(s.log_probabilities(x, y)[:, :6], s.log_probabilities(z, y)[:, :6], atol=1e-5)
    small = {k: v.astype(np.float64) for k, v in w.items()}
    _, g = attention.gradients(small, x, y, real)
    for k in attention.SHAPES:
        at = tuple(int(rng.integers(0, n)) for n in small[k].shape)
        if k == "embed":
            at = (int(x[0, 20]), 3)
        old, values = small[k][at], []
        for e in (1e-5, -1e-5):
            small[k][at] = old + e
            values.append(attention.gradients(small, x, y, real)[0])
        small[k][at] = old
        assert abs((values[0] - values[1]) / 2e-5 - g[k][at]) < 1e-5


def test_leaks_of_short_items_between_other_words(spark):
    """9 of an item's 16 words among 15 others: benchmark words hold under 0.4 of each window's weight."""
    items = [(i, " ".join(f"q{i}x{j}" for j in range(12)) + ". " + " ".join(f"r{i}x{j}" for j in range(4)) + ".") for i in range(20)]
    fill = lambda i, n: [f"z{i}x{j}" for j in range(n)]
    kept = lambda i: [items[i][1].split()[j] for j in (0, 2, 4, 6, 9, 12, 13, 14, 15)]
    mixed = lambda i: [x for pair in zip(kept(i), fill(i, 9), strict=True) for x in pair]
    rows = [(i, " ".join(fill(50 + i, 60) + mixed(i) + fill(100 + i, 66))) for i in range(10)] + [(200 + i, " ".join(fill(200 + i, 150))) for i in range(50)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    # at 24 words a window the 9 words hold 9 / 24
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()} == {(i, i) for i in range(10)}
    assert decontam.keep_clean(df, bench).count() == 50


def test_leaks(spark, docs, hard, none):
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"q{rng.integers(3000)}" for _ in range(25)) + ". The answer is " + " ".join(f"r{rng.integers(500)}" for _ in range(4)) + ".") for i in range(30)]
    fill = lambda n: " ".join(f"z{rng.integers(4000)}" for _ in range(n))
    cut_out = lambda t: " ".join(w for k, w in enumerate(t.split()) if k % 7)
    rows = [(i, f"{fill(50)} {items[i][1]} {fill(60)}") for i in range(10)] + [(100 + i, f"{fill(40)} {cut_out(items[i][1]).upper()} {fill(9)}") for i in range(10)] + [(200 + i, fill(200)) for i in range(50)] + [(300, None), (301, "")]
    bench = spark.createDataFrame([*items, (90, None), (None, "x y"), (91, "...")], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (16 << 20, 2000):  # one block and several
        assert {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench, block_bytes=size).collect()} == {(i, i) for i in range(10)} | {(100 + i, i) for i in range(10)}
    assert sorted(r.doc_id for r in decontam.keep_clean(df, bench).collect()) == sorted(i for i, _ in rows if i >= 200)
    assert decontam.keep_clean(hard, bench).count() == hard.count() and decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.keep_clean(none, bench).count() == 0


def test_common_length():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = rng.integers(-1, 6, rng.integers(1, 20)), rng.integers(-1, 6, rng.integers(0, 30))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y and x >= 0 else max(t[i, j + 1], t[i + 1, j])
        assert decontam.common_length(a, b) == t[-1, -1]


def test_main_text(spark):
    body = "<p>Tom &amp; <b>Ann</b>\n  met   again.<br>Twice &lt;today&gt;.<p>Second <a href=/x>linked</a> part<ul><li>one<li>two</ul>"
    page = f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head</h1>{body}<div id=comments><p>I like it</p></div></article><aside>More</aside><form>Mail</form><footer>&copy; us</footer><script>var a='<p>no</p>'</script>"
    want = "Head\nTom & Ann met again. Twice <today>.\nSecond linked part\none\ntwo"
    assert extraction.main_text(page) == want
    plain = "<body><div><a href=1>a</a> <a href=2>bb</a> <a href=3>ccc</a></div><div><div><p>" + "long text " * 30 + "</p><p>" + "more text " * 30 + "</p></div></div></body>"
    assert extraction.main_text(plain) == ("long text " * 30).strip() + "\n" + ("more text " * 30).strip()
    odd = [None, "", "just text", "<p>unclosed", "<!-- a", "</div></p>x", "<div " * 50, "<b>" * 3000 + "deep" + "</b>" * 3000]
    assert [extraction.main_text(x) for x in odd[:4]] == ["", "", "just text", "unclosed"]
    df = spark.createDataFrame([(i, None, x) for i, x in enumerate([page, *odd])], "page_id long, url string, html string")
    got = {r.page_id: r for r in extraction.extract(df).collect()}
    assert len(got) == 9 and got[0].text == want and got[0].n_chars == len(want) and got[8].text == "deep"
    assert extraction.extract(df.limit(0)).count() == 0


def test_reply_trees(spark):
    rows = [(1, 1, None, "system", "s", 0.0), (1, 2, 1, "user", "u", 1.0), (1, 3, 2, "assistant", "bad", 0.0), (1, 4, 2, "assistant", "good", 5.0), (1, 5, 4, "user", "more", 1.0), (2, 7, 99, "user", None, None), (None, 1, None, "user", "x", 0.0)]
    m = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    paths = collections.defaultdict(list)
    for r in chat.leaf_paths(m.where("conv_id is not null")).collect():
        paths[r.conv_id, r.leaf].append((-r.up, r.msg_id))
    assert {k: [x for _, x in sorted(v)] for k, v in paths.items()} == {(1, 3): [1, 2, 3], (1, 5): [1, 2, 4, 5], (2, 7): [7]}
    made = {r.conv_id: r for r in chat.format_trees(m).collect()}
    assert chat.read_turns(made[1].formatted) == [("system", "s"), ("user", "u"), ("assistant", "good"), ("user", "more")]
    assert [made[1].formatted[a : a + n] for a, n in zip(made[1].loss_starts, made[1].loss_lengths, strict=True)] == ["good"] and set(made) == {1, 2, None}
    with pytest.raises(ValueError):
        chat.format_trees(spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)], m.schema))
    assert chat.format_trees(m.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "\\<|", "<\\|", "\\", "<", "|im_end|>", "", "a\nb\n", "<|im_start|>\\n"])
def test_turns_come_back(text):
    turns = [(text, text), ("assistant", text), ("user", "|" + text), ("assistant", text + "<")]
    formatted, starts, lengths = chat.format_turns(turns)
    assert chat.read_turns(formatted) == turns
    assert "".join(chat.unescape(formatted[a : a + n]) for a, n in zip(starts, lengths, strict=True)) == text + text + "<"


def test_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>"), (1, 1, "assistant", "yo <|im_end|>"), (2, 5, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_trees(chat.turns_as_replies(df))).collect()}
    said = "yo <|im_end|>"
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(f"user\nhi\nassistant\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256((said * 2).encode()).hexdigest() and got[1].loss_chars == 26 and got[2].n_turns == 1


def test_packing(docs, hard, none):
    for df in (docs, hard):
        rows = packing.best_fit_pack(df, capacity=64, rows_per_bucket=10).collect()
        assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == collections.Counter(r.doc_id for r in df.collect())
        bins = collections.defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for items in bins.values():
            end = 0
            for offset, length in sorted(items):
                assert offset == end
                end += length
            assert end <= 64
        total = sum(r.length for r in rows)
        assert len(bins) <= math.ceil(total / 64) * 1.03 + 1
    assert packing.best_fit_pack(none).count() == 0


def test_pipeline(spark, docs):
    """Each stage on its own input against a plain version; the operators' own plain versions are in test_brute."""
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    kept, bench = docs, spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count()
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        stay = {r.doc_id for r in kept.collect()}
        if name == "quality rules":
            failed = lambda m: m[0] < 10 or 100 * m[4] > 20 * m[0]
            want = {i for i, t in rows if not failed(plain_measures(t))}
        if name == "language ID":
            want = {r.doc_id for r in langid.identify(before).where("lang_pred <> 'und' and not ambiguous").collect()}
        if name == "SimHash near-dedup":
            want = {rows[i][0] for i in kept_by_pairs(rows)}
        if name == "benchmark decontamination":
            want = {i for i, _ in rows} - {r.doc_id for r in decontam.contaminated(before, bench).collect()}
        assert stay == want
    packed = p.run(spark, SF).collect()
    tokenizer, bins = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json")), collections.defaultdict(int)
    sizes = {i: len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1 for i in stay}
    total = collections.Counter()
    for r in packed:
        bins[r.sequence_id] += r.length
        total[r.doc_id] += r.length
    assert total == sizes and max(bins.values()) <= 2048
    pieces = [n for s in sizes.values() for n in (*[2048] * (s // 2048), *([s % 2048] if s % 2048 else []))]
    assert len(bins) == len(plain_best_fit(pieces, 2048))


def plain_subwords(words, final, kept):
    """Subwords of a few words by plain loops; of pairs the `kept` most frequent ones."""
    size = len(final)
    first, inner, pairs = np.zeros(size), np.zeros(size), collections.Counter()
    for w, n in words:
        before = -1
        for i in np.frombuffer(w, "<u4").tolist():
            if before < 0:
                first[i] += n
            else:
                inner[i] += n
                pairs[before * size + i] += n
            before = -1 if final[i] else i
    total, kinds = np.zeros(size), np.zeros(size)
    for key, n in pairs.items():
        total[key // size] += n
        kinds[key // size] += 1
    return lm.Subwords(first, inner, dict(pairs.most_common(kept)), total, kinds)


@pytest.mark.parametrize("kept", [1000, 20, 0])
def test_class_shares_add_up(kept):
    rng = np.random.default_rng(6)
    size = 300
    class_of, final = rng.integers(0, attention.LAST, size).astype(np.uint8), rng.integers(0, 2, size)
    words = {bytes([65 + k]): rng.integers(0, size, rng.integers(0, 6)).astype("<u4").tobytes() for k in range(60)}
    subwords = plain_subwords([(w, k + 1) for k, w in enumerate(words.values())], final, kept)
    s = lm.class_shares({w: k + 1 for k, w in enumerate(words) if k % 2}, words.get, subwords, class_of, final)
    sums = np.bincount(class_of, weights=np.exp(s.first), minlength=attention.CLASSES)
    assert np.allclose(sums[np.bincount(class_of, minlength=attention.CLASSES) > 0], 1)
    pasts = [w[: 4 * k] for w in words.values() for k in (1, 2, 3) if len(w) > 4 * k] + [np.array([size - 1, 0], "<u4").tobytes()]
    for past in pasts:
        begun, *rest = np.frombuffer(past, "<u4").tolist()
        before = begun
        for i in rest:
            (begun, _), before = s.inside(begun, before, i), i
        assert np.isclose(sum(np.exp(s.inside(begun, before, i)[1]) for i in range(size)), 1)


def test_subword_counts(spark, docs):
    path = vocabulary_path("word_bpe_49k.json")
    tokenizer = WordTokenizer(path, splits_parts(path))
    counts = collections.Counter(w for r in docs.limit(20).collect() for w in r.text.encode().lower().split())
    df = spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long").repartition(3)
    final = np.array([int((tokenizer_name or "").endswith("</w>")) for tokenizer_name in vocabulary_names(path)])
    got = lm.subword_counts(df, path, final, 10**6, flush=50)
    want = plain_subwords([(tokenizer.fresh(w), n) for w, n in counts.items()], final, 10**6)
    assert got.pairs == want.pairs and all((getattr(got, k) == getattr(want, k)).all() for k in ("first", "inner", "total", "kinds"))


def vocabulary_names(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.id_to_token(i) for i in range(t.get_vocab_size())]


def test_scores_match_a_plain_scorer(spark, docs, monkeypatch):
    """One token at a time, each once, with nothing but the weights and shares of the model."""
    made = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **k: made.setdefault("model", train(*a, **k)))
    got = {r.doc_id: r.score for r in lm.score(docs, most_frequent=300, most_pairs=500, least_docs=60).collect()}
    m = made["model"]
    w, s, tokens = attention.unpack(m.weights), m.shares, WordTokenizer(m.path, m.splits)
    targets = {attention.LAST: attention.INSIDE}
    for r in docs.orderBy(F.length("text")).limit(40).collect():
        codes, shares = [], 0.0
        for word in (r.text or "").encode().lower().split():
            begun, before, starts = -1, -1, True
            for i in np.frombuffer(tokens.fresh(word), "<u4").tolist():
                if starts:
                    codes.append(int(m.class_of[i]))
                    begun, log = i, s.first[i]
                else:
                    codes.append(attention.LAST if m.final[i] else attention.INSIDE)
                    begun, log = s.inside(begun, before, i)
                shares += log
                before, starts = i, bool(m.final[i])
        codes.append(attention.END)
        total = 0.0
        for k, code in enumerate(codes):
            a = k // attention.STEP * attention.STEP  # where the step of this token begins
            inputs = [codes[j - 1] if j > 0 else attention.END for j in range(a - attention.CONTEXT, k + 1)]
            h = [w["embed"][x] + w["place"][p] for p, x in enumerate(inputs)]
            q = h[-1] @ w["wq"]
            weight = np.array([math.exp(float(q @ (x @ w["wk"])) / attention.ROOT) for x in h])
            out = sum(p * (x @ w["wv"]) for p, x in zip(weight / weight.sum(), h, strict=True)) + h[-1]
            z = out @ w["out"] + w["bias"]
            total += float(z[targets.get(code, code)]) - math.log(sum(math.exp(float(x)) for x in z))
        want = (total + shares) / math.log(10)
        assert abs(got[r.doc_id] - want) < 1e-3 * max(1, abs(want))


def test_the_model_learns_from_more_of_a_larger_corpus(spark, monkeypatch):
    rows = [(i, f"w{i % 50} x{i % 7} y{i % 11} w{i % 50}") for i in range(600)]
    df = spark.createDataFrame(rows, "key long, text string").select("key", F.col("text").cast("binary").alias("text"))
    sizes = []
    plain = lm.sample_counts
    monkeypatch.setattr(lm, "sample_counts", lambda s, f: sizes.append(s.count()) or plain(s, f))
    counts = lm.word_counts(df.select("text")).where(F.octet_length("word") > 0)
    for n in (200, 600):
        lm.train(df.where(F.col("key") < n), counts, {}, vocabulary_path("word_bpe_49k.json"), 0.5, 20, 100, rounds=1)
    assert 60 < sizes[0] < 140 and 240 < sizes[1] < 360


def test_codes_tell_beginnings_from_what_is_inside_words():
    class_of, final = np.array([4, 5, 6], np.uint8), np.array([0, 1, 0])
    ids = np.array([0, 2, 1, 1, 0, 1])
    assert lm.coded(ids, class_of, final).tolist() == [4, attention.INSIDE, attention.LAST, 5, 4, attention.LAST]
    assert [len(p) // 4 for p in lm.word_parts(ids.astype("<u4").tobytes(), final.tolist())] == [3, 1, 2]
    _, targets, _ = attention.windows([lm.coded(ids, class_of, final).tobytes()])
    assert targets[0, :6].tolist() == [4, attention.INSIDE, attention.INSIDE, 5, 4, attention.INSIDE]
