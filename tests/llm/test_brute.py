"""Operators against brute force: every pair, every window, every node, in plain Python."""

import collections
import math
import statistics
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from trialforge.llm import attribution, chat, decontam, extraction, langid, packing, quality, simhash, urlfilter
from trialforge.llm.common import vocabulary_path


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def clashing(df, *names):
    """df with further columns of names that operators use themselves."""
    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})


# --- near-duplicates


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def kept_by_pairs(rows, similarity=0.8):
    """Numbers of rows (doc_id, text) that stay when all pairs are compared."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= similarity * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return {min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for g in groups.values()}


def test_keep_one_matches_all_pairs(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rng = np.random.default_rng(2)
    for k in range(40):  # near copies of some at similarities from 0.5 to 1
        words = rows[k][1].split(" ")
        for i in rng.choice(len(words), len(words) * (k % 10) // 60, replace=False):
            words[i] = f"new{k}w{i}"
        rows.append((10_000 + k, " ".join(words)))
    want = {rows[i][0] for i in kept_by_pairs(rows)}
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "uid", "__uid0", "node", "group", "same", "fp", "keys", "label")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want


def test_keep_one_of_hot_groups(spark, monkeypatch):
    """A group of near copies of many pages, chained so that its ends differ, and a common passage that links nothing."""
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(5000)}"
    base, rows = [word() for _ in range(60)], []
    for k in range(240):
        base[rng.integers(60)] = word()
        rows.append((k, " ".join(base)))
    shared = " ".join(word() for _ in range(40))
    rows += [(1000 + k, shared + " " + " ".join(word() for _ in range(40))) for k in range(120)]
    want = {rows[i][0] for i in kept_by_pairs(rows)}
    monkeypatch.setattr(simhash, "PAGE", 16)
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want and len(want) > 110


# --- language


def test_language_matches_plain_naive_bayes(docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    size = 1 << langid.BITS

    def grams(text):
        raw = b" " + text.lower().encode() + b"  "
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 & 0xFFFFFFFF) >> (32 - langid.BITS) for i in range(len(raw) - 2)]

    counts = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5 and text is not None and lang is not None:
            counts[lang].update(grams(text))
    languages = sorted(counts)
    codes = langid.codewords(len(languages))
    total = {x: sum(counts[x].values()) + 0.5 * size for x in languages}

    def odds(bucket, b):
        mean = lambda sign: statistics.fmean((counts[x][bucket] + 0.5) / total[x] for i, x in enumerate(languages) if codes[i, b] * sign > 0)
        return math.log(mean(1) / mean(-1))

    known: dict = {}
    got = {r.doc_id: r for r in langid.identify(clashing(docs, "bucket", "w", "seen", "score", "held_out", "lang_pred")).collect()}
    for i, text, _ in rows[:60]:
        if not text or not any(map(str.isalpha, text)):
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        g = collections.Counter(grams(text))
        for x in g:
            if x not in known:
                known[x] = [odds(x, b) for b in range(codes.shape[1])]
        margin = [sum(n * known[x][b] for x, n in g.items()) / sum(g.values()) for b in range(codes.shape[1])]
        loss = [sum(math.log1p(math.exp(-12.0 * codes[k, b] * m)) for b, m in enumerate(margin)) for k in range(len(languages))]
        best = min(range(len(languages)), key=lambda k: loss[k])
        assert got[i].lang_pred == languages[best] and abs(got[i].score - 1 / sum(math.exp(loss[best] - x) for x in loss)) < 1e-3
        lead = (sorted(loss)[1] - loss[best]) / codes.shape[1]
        assert abs(lead - 0.05) < 1e-3 or got[i].ambiguous == (lead < 0.05)


def test_more_languages_than_any_fixed_number(spark):
    rng = np.random.default_rng(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(300):
        own = ["".join(letters[i] for i in rng.integers(0, 26, 7)) for _ in range(12)]
        rows += [(5 * k + j, " ".join(own[i] for i in rng.integers(0, 12, 60)), f"l{k:03}") for j in range(4)]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()
    lang = {i: x for i, _, x in rows}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.98


# --- quality


def test_windows_of_equal_hashes_are_told_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 2 + k % 5, 40 + 7 * k))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.with_text_measures(df, hash_bits=3).collect()}
    for k, text in rows:
        w = text.split()
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        assert got[k] == len({j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_host_rates_match_a_plain_prior(spark):
    rng = np.random.default_rng(6)
    good, rows = "a fine text of more than ten words that no rule has anything against", []
    for h in range(30):
        share = rng.random()
        rows += [(len(rows) + i, "bad" if rng.random() < share else good, f"h{h}" if h else None) for i in range(int(rng.integers(1, 40)))]
    got = {r.doc_id: r for r in quality.judge(clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"), "n_words", "host_rate", "kept", "__host", "host_ok", "__words")).collect()}
    docs, bad = collections.Counter(s for _, _, s in rows), collections.Counter(s for _, t, s in rows if t == "bad")
    mean, rates = sum(bad.values()) / len(rows), [bad[s] / n for s, n in docs.items()]
    chance = mean * (1 - mean)
    between = max(statistics.variance(rates) - chance * statistics.fmean(1 / n for n in docs.values()), 1e-6)
    weight = min(max(chance / between - 1, 1.0), 1e4)
    for i, t, s in rows:
        rate = (bad[s] + weight * mean) / (docs[s] + weight)
        assert abs(got[i].host_rate - rate) < 1e-9 and got[i].kept == (t == good and rate <= 0.5)
    assert len({r.kept for r in got.values() if not r.base_failed}) == 2


# --- URL filter


def test_verdicts_match_plain_propagation(spark):
    rng = np.random.default_rng(7)
    hosts = [f"h{i}.{t}" for i, t in enumerate(["net", "org", "info", "com", "net"] * 5)]
    rules = [("allow", "org", "/"), ("block", "com", "/"), ("block", "h0.net", "/a"), ("allow", "h0.net", "/a"), ("allow", "net", "/zz/long")]
    pages = []
    for k in range(120):
        out = rng.choice(hosts, rng.integers(0, 5))
        page_html = "".join(f"<a class=x href='//{h.upper()}/p'>t</a>" for h in out)
        pages.append((k, f"http://{hosts[k % 25]}/{'a' if k % 3 else 'b'}", page_html, list(out)))
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r.page_id: r for r in urlfilter.judge_pages(clashing(df, "host", "path", "rule", "said", "trust", "rank", "seed", "src", "dst", "verdict"), rules, rounds=20).collect()}

    def rule(host, path):
        fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(fit, key=lambda r: len(r[1] + r[2]), default=None)  # the first of equally long ones

    edges, good, bad = collections.Counter(), collections.Counter(), collections.Counter()
    for k, url, _, out in pages:
        host = hosts[k % 25]
        edges.update((host, h) for h in out if h != host)
        r = rule(host, url[url.index(host) + len(host) :])
        (good if r and r[0] == "allow" else bad if r else collections.Counter())[host] += 1

    def ranks(edges, seeds):
        out = collections.Counter()
        for (s, _), n in edges.items():
            out[s] += n
        rank = {h: 0.15 * seeds[h] for h in hosts}
        for _ in range(20):
            rank = {h: 0.15 * seeds[h] + 0.85 * sum(n / out[s] * rank[s] for (s, t), n in edges.items() if t == h) for h in hosts}
        return rank

    trust, distrust = ranks(edges, good), ranks(collections.Counter({(t, s): n for (s, t), n in edges.items()}), bad)
    for k, url, _, _ in pages:
        host = hosts[k % 25]
        r = rule(host, url[url.index(host) + len(host) :])
        assert abs(got[k].trust - trust[host]) < 1e-3 and abs(got[k].distrust - distrust[host]) < 1e-3
        assert got[k].verdict == (r[0] if r else "block" if distrust[host] > 2 * trust[host] else "allow")
        assert got[k].rule == (r[1] + r[2] if r else None)
    assert got[0].rule is None and got[25].rule == "h0.net/a" and got[25].verdict == "block"  # the first of two equal rules
    assert len({got[k].verdict for k in got if got[k].rule is None}) == 2


# --- tokens


def test_long_runs_of_white_space():
    encoding, _ = attribution.encoder(vocabulary_path("byte_bpe_50k.tiktoken"))
    for run in (" " * 6000, "\n" * 6000, " \n\t" * 3000, "\xa0" * 5001):
        for a in ("", "x", "é. "):
            for b in ("", "y", " z", "1", "!"):
                assert attribution.encode(encoding, a + run + b) == encoding.encode_ordinary(a + run + b)
    assert len(attribution.encode(encoding, "x" + " " * 2_000_000 + "y")) > 0


def test_sections_of_white_space_and_clashing_names(spark):
    df = clashing(spark.createDataFrame([(1, "a" + "\n" * 1_200_000 + "b"), (2, None)], "doc_id long, text string"), "field", "section", "f0", "n_tokens", "n_chars")
    got = attribution.section_tokens(df).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c")).collect()
    assert {(r.doc_id, r.n, r.c) for r in got} == {(1, 1_200_001, 1_200_002), (2, 1, 0)}


# --- decontamination


def longest_common(a, b):
    t = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, t[j] = t[j], before + 1 if x == y else max(t[j], t[j - 1])
    return t[-1]


def plain_leaks(b, w, cosine, sure, likely):
    """All stretches of all items: no index, no regions, every window."""
    found = {}
    starts = b.windows(len(w))
    z = np.array([b.basis[w[a : a + b.window]].sum(0) for a in starts], float)
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    for item in range(len(b.ids)):
        words, answer, reach = b.telling(item).tolist(), b.answer(item).tolist(), b.window + 2 * len(b.words[item])
        cos = np.array([max(float(v @ b.vectors[p]) for p, x in enumerate(b.passages) if x[0] == item) for v in z])
        for a in range(len(w)):
            part = w[a : a + reach].tolist()
            if part[0] not in words:
                continue
            n = longest_common(words, part)
            near = cos[(starts < a + reach) & (np.minimum(starts + b.window, len(w)) > a) & (cos >= cosine)]
            told = longest_common(answer, part) >= 0.75 * len(answer)
            if n >= likely * len(words) - 1e-9 and len(near) and (told or n >= sure * len(words)):
                found[item] = max(found.get(item, (0, False)), (n / len(words), told))
    return {item: x for item, x in found.items()}


def test_leaks_match_all_stretches(spark, docs):
    rng = np.random.default_rng(9)
    few = docs.limit(40).select("doc_id", "text").collect()
    items = [(f"q{i}", " ".join(rng.choice(few[i].text.split(), 14)) + ". So " + " ".join(f"r{rng.integers(60)}" for _ in range(5)) + ".") for i in range(8)]

    def mangled(text, share):
        out = []
        for x in text.split():
            if rng.random() > share:
                out.append(x)
            if rng.random() < share:
                out.append(f"z{rng.integers(900)}")
        return " ".join(out)

    rows = [(i, f"{few[20 + i % 20].text[:400]} {mangled(items[i % 8][1], i / 60)} {few[i % 20].text[:300]}") for i in range(40)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    (b, _), = decontam.fitted_blocks(df, bench, 24, 16, decontam.SHARE, 16 << 20)
    got = collections.defaultdict(dict)
    extra = clashing(df, "words", "item_id", "word", "y", "cosine")
    for r in decontam.contaminated(extra, clashing(bench, "doc_id"), 24, 16).collect():
        got[r.doc_id][b.ids.index(r.item_id)] = (r.overlap, r.has_answer)
    want = {i: plain_leaks(b, b.numbers(t.encode()), decontam.COSINE, decontam.SURE, decontam.LIKELY) for i, t in rows}
    assert dict(got) == {i: x for i, x in want.items() if x}
    assert 5 < len(got) < 40
    assert {r.doc_id for r in decontam.keep_clean(extra, bench, 24, 16).collect()} == set(want) - set(got)


def test_latent_candidates_miss_few_paraphrases(spark, docs):
    """Recall of the cosine search: of what the subsequence and answer checks alone find, 0.9 or more are candidates."""
    rng = np.random.default_rng(10)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items, texts = bench.orderBy("item_id").collect(), [r.text for r in docs.limit(60).collect()]
    rows = []
    for k in range(240):
        words = items[k % len(items)].text.split()
        kind = k % 3
        if kind == 0:  # words left out
            words = [x for x in words if rng.random() > 0.25]
        elif kind == 1:  # others put in between
            words = [y for x in words for y in ([x, str(rng.choice(texts[k % 60].split()))] if rng.random() < 0.5 else [x])]
        else:  # others in place of some
            words = [x if rng.random() > 0.25 else str(rng.choice(texts[k % 60].split())) for x in words]
        rows.append((k, texts[k % 60][:800] + " " + " ".join(words) + " " + texts[(k + 1) % 60][:800]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    (b, _), = decontam.fitted_blocks(df.unionByName(docs.select("doc_id", "text")), bench, 24, 64, decontam.SHARE, 16 << 20)
    numbered = [b.numbers(t.encode()) for _, t in rows]
    found = [{x[0] for x in decontam.leaks(b, w, decontam.COSINE, decontam.SURE)} for w in numbered]
    all_found = [{x[0] for x in decontam.leaks(b, w, -2.0, decontam.SURE)} for w in numbered]
    assert sum(map(len, found)) >= 0.9 * sum(map(len, all_found)) and sum(map(len, all_found)) > 200
    assert sum(k % len(items) in {b.ids.index(items[k % len(items)].item_id)} & f or bool(f) for k, f in enumerate(found)) > 0.9 * len(rows)


def test_full_rank_cosines_are_those_of_tf_idf(spark):
    rng = np.random.default_rng(11)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 30, 20)) + ".") for i in range(12)]
    df, bench = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    (b, _), = decontam.fitted_blocks(df, bench, 24, 999, decontam.SHARE, 16 << 20)
    size = len(b.vocabulary)
    tf = np.array([np.bincount(b.words[i][a:z], minlength=size) * b.idf[:size] for i, a, z in b.passages])
    tf /= np.linalg.norm(tf, axis=1, keepdims=True)
    assert np.allclose(b.vectors @ b.vectors.T, tf @ tf.T, atol=1e-4)


# --- HTML


def random_page(rng, depth=0):
    """(html, node) of a random well-formed tree; a node is (tag, children), children are nodes and texts."""
    tag = str(rng.choice(["div", "section", "ul", "span", "a", "b"])) if depth else "div"
    parts, children = [], []
    for _ in range(int(rng.integers(0, 5 if depth < 5 else 1))):
        if rng.random() < 0.5:
            text = " ".join("x" * int(rng.integers(1, 9)) for _ in range(int(rng.integers(1, 30))))
            if children and isinstance(children[-1], str):
                continue
            parts.append(text)
            children.append(text)
        else:
            inner, node = random_page(rng, depth + 1)
            parts.append(inner)
            children.append(node)
    return f"<{tag}>{''.join(parts)}</{tag}>", (tag, children)


def plain_main_text(root):
    def count(n, what):
        return sum(what(c) + count(c, what) for c in n[1] if isinstance(c, tuple))

    def text_of(n):
        return "".join(c if isinstance(c, str) else text_of(c) for c in n[1])

    chars = lambda n: len("".join(text_of(n).split()))

    def link_chars(n):
        return chars(n) if n[0] == "a" else sum(link_chars(c) for c in n[1] if isinstance(c, tuple))

    page = link_chars(root) / max(1, chars(root))

    def density(n):
        c, t, lc, lt = chars(n), max(1, count(n, lambda x: 1)), link_chars(n), max(1, count(n, lambda x: x[0] == "a"))
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + page * c + math.e)
        value = c / t * math.log(max(c / max(1, lc) * t / lt, 1.0) + (1e-9 if base > 1 else 0))
        return value / math.log(base + 1e-9) if base > 1 else value

    nodes, paths = [], {}

    def walk(level):  # parents before children, by levels
        while level:
            nodes.extend(level)
            below = []
            for n in level:
                for c in n[1]:
                    if isinstance(c, tuple):
                        paths[id(c)] = n
                        below.append(c)
            level = below

    walk([root])
    best = max(nodes, key=lambda n: sum(density(c) for c in n[1] if isinstance(c, tuple)))
    path = [best]
    while id(path[-1]) in paths:
        path.append(paths[id(path[-1])])
    least = min(map(density, path))
    if least < density(best) / 2:  # diluted
        least = math.sqrt(least * density(best))
    chosen = next((n for n in path[::-1] if density(n) > least and n is not root), best)
    chosen = chosen if chars(chosen) else root
    blocks = [""]

    def put(n):
        edge = n[0] in ("div", "section", "ul", "body")
        if edge:
            blocks.append("")
        for c in n[1]:
            if isinstance(c, str):
                blocks[-1] += c
            else:
                put(c)
        if edge:
            blocks.append("")

    put(chosen)
    return "\n".join(" ".join(b.split()) for b in blocks if b.split())


def test_main_text_matches_plain_densities():
    rng = np.random.default_rng(12)
    for _ in range(400):
        made = [random_page(rng) for _ in range(int(rng.integers(1, 4)))]
        page = "<html><body>" + "".join(x for x, _ in made) + "</body></html>"
        assert extraction.main_text(page) == plain_main_text(("body", [n for _, n in made]))


@pytest.mark.parametrize("unit", ["<a ", '<a "', '<a "> "', "<div>", "<b>", "</i>", "<li><b>", "<!-", "<script>", "&", "<a '\">", "<td>", "<nav>", "<p>x", "<table><td>"])
def test_broken_pages_take_time_by_their_length(unit):
    import time

    for head in ("", "<b>" * 20_000, "<nav>", "<ul>"):
        began = time.process_time()
        extraction.main_text(head + unit * 20_000 + "<p>end")
        assert time.process_time() - began < 3


def test_an_articles_own_header_stays():
    page = "<body><header class=site-header><a href=/>Home</a></header><article><header class='article-header'><h1>Head</h1></header><p>" + "text " * 40 + "</p></article><footer>x</footer></body>"
    assert extraction.main_text(page) == "Head\n" + ("text " * 40).strip()


def test_pages_with_clashing_columns_and_nothing_in_them(spark):
    df = clashing(spark.createDataFrame([(1, "u", "<p>a</p>"), (None, None, None), (1, "u", "<p>a</p>")], "page_id long, url string, html string"), "text", "n_chars")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extraction.extract(df).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]


# --- chat


def test_conversations_without_an_id_and_clashing_columns(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, 0, "user", None)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "up", "leaf", "msg_id", "parent_id", "score", "place", "turns", "above")
    got = {r.conv_id: r for r in chat.digests(chat.format_trees(chat.turns_as_replies(df))).collect()}
    assert set(got) == {None, 3} and got[None].n_turns == 2 and got[None].loss_chars == 1
    m = spark.createDataFrame([(None, 1, None, "user", "x", 0.0), (None, 2, 1, "assistant", "y", 1.0)], "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    made = chat.format_trees(clashing(m, "up", "leaf", "low", "above", "loss")).collect()
    assert [(r.conv_id, chat.read_turns(r.formatted)) for r in made] == [(None, [("user", "x"), ("assistant", "y")])]


# --- packing


def test_packing_of_equal_and_missing_ids(spark):
    rows = [(None, "same text here")] * 60 + [(7, "other text of the id")] * 60 + [(7, None)] * 5
    got = packing.best_fit_pack(clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "uid", "bucket", "rank", "length", "start"), capacity=16, rows_per_bucket=8).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 16
    assert len(got) == 125 and sum(r.doc_id is None for r in got) == 60
