"""The corpus operators against brute force, round trips and held-out labels, with the odd cases of their docstrings."""

import random
import re
import zlib

import numpy as np
import pytest

from tickwell.llm import ann, decontaminate, html_extract, language_id, mixing, near_dedup, queries, token_counts, token_output, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, rank int"
SF = "/root/testdata/sf0.001"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or {}).get(i, "s"), len(t or ""), "x", 1) for i, t in enumerate(texts)], DOCS)


def sentence(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_near_duplicates_equal_brute_force(spark):
    base = sentence(1)
    near = base.split()
    near[30] = "CHANGED"
    texts = [base, base.upper(), " ".join(near), sentence(2), None, "", " \t\n", "one two", "ONE  two", sentence(3), base]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs(spark, texts)).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert {d: (r.component_id, r.n_shingles, r.kept) for d, r in got.items()} == {i: (comp[i], len(sets[i]), comp[i] == i) for i in range(len(texts))}
    assert near_dedup.near_duplicates(docs(spark, []), t=2).count() == 0


def test_url_filter_equals_every_rule_tried(spark):
    urls = [None, "", "no scheme", "http://A.example.org/es/1", "https://x.org", "http://x.org/a?b", "http://ads-track.example.net/", "http://example.org/en/17", "http://org/", "http://b.com/de/#x", "http://b.com/fr/", "http://notcom/de/", "http://b.com/de/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect())
    assert len(got) == len(urls) + 1
    for i, host, path, rule, verdict in got:
        rest = urls[i].split("://", 1)[1] if urls[i] and "://" in urls[i] else ""
        h = re.match(r"[^/?#]*", rest)[0].lower()
        p = re.match(r"[^?#]*", rest[len(h) :])[0]
        fits = [(len(r), r, v) for r, v in url_filter.HOST_RULES if (h == (x := r.split("/")[0]) or h.endswith("." + x)) and p.startswith(r[len(x) :])]
        want = max(fits)[1:] if fits else (None, "block" if "ads-track." in h else "allow")
        assert (host, path, rule, verdict) == (h, p, *want)


def test_leaks_are_found_and_clean_documents_left(spark):
    items = [sentence(100 + i, 30) for i in range(5)] + ["short item"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    edited = items[2].split()
    edited[14] = "other"
    texts = [sentence(1) + " " + items[0].upper() + " " + sentence(2), sentence(3), None, "", " ".join([sentence(4), *edited]), sentence(5) + " short  item " + sentence(6), items[1][: len(items[1]) // 3], "of course"]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs(spark, [*texts, texts[0]]), bench).collect()}
    assert set(got) == {(0, 0), (8, 0), (5, 5)} | ({(4, 2)} if (4, 2) in got else set())
    assert got[0, 0].similarity == 1.0 and got[0, 0].start == 60 and got[0, 0].hamming == 0
    assert decontaminate.find_leaks(docs(spark, texts), bench.limit(0)).count() == 0


def test_edited_passages_just_above_the_threshold_are_all_found(spark):
    lead = "as said in the notes of the last chapter of this book".split()
    items = {i: [*lead, *sentence(300 + i, 30 + i % 11).split()] for i in range(60)}
    texts, near = [], {}
    for i, words in items.items():
        for at in (len(lead) + 10, len(lead) + 15):
            edited = words.copy()
            edited[at] = "edited"
            near[len(texts)] = i
            texts.append(" ".join([sentence(900 + i), *edited, sentence(1900 + i)]))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, texts), bench).collect()
    bags = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in items.items()}
    weight = {s: np.log(1 + 60 / sum(s in b for b in bags.values())) for b in bags.values() for s in b}
    want = set()
    for d, i in near.items():
        w = texts[d].lower().split()[60 : 60 + len(items[i])]
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        both, either = (sum(weight.get(s, np.log(61)) for s in x) for x in (own & bags[i], own | bags[i]))
        want |= {(d, i)} if both >= 0.75 * either else set()
    assert len(want) > 60 and {(r.doc_id, r.item_id) for r in got} == want and all(r.similarity < 0.86 for r in got)


def test_language_and_toxicity_on_held_out_rows(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    told = queries.op4_language_id(spark, SF).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in told]) > 0.95 and all(0 <= r.score <= 1 for r in told)
    model = language_id.learn(table, ~language_id.held_out())
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs(spark, [None, "", "123 !", "a", "é" * 100_000]), model).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and odd[3][0] in model.langs and odd[4][0] in model.langs
    assert language_id.identify(docs(spark, ["a"]), None).first().lang_pred == "und"


def test_ppm_code_lengths_equal_direct_computation():
    text = b"abracadabra abracadabra"
    from collections import Counter

    padded = b"\0\0\0" + text
    grams = Counter(padded[i - 3 : i + 1] for i in range(3, len(padded)))
    codes = np.array([g[3] | g[2] << 8 | g[1] << 16 | g[0] << 24 for g in grams], np.int64)
    m = language_id.Model({"x": language_id.Tree(codes, np.array(list(grams.values()), float))})

    def bits(context, c):
        if context is None:
            return 8.0
        own = Counter()
        for g, n in grams.items():
            if g[:3].endswith(context):
                own[g[3]] += n
        shorter = bits(context[1:] if context else None, c)
        total, kinds = sum(own.values()), len(own)
        if own[c]:
            return -np.log2(own[c] / (total + kinds))
        return (-np.log2(kinds / (total + kinds)) if total else 0.0) + shorter

    probe = b"cadz abrr"
    want = sum(bits((b"\0\0\0" + probe)[i : i + 3], c) for i, c in enumerate(probe))
    own = np.frombuffer(probe, np.uint8)
    got = m.lengths(*language_id._padded(own, np.array([0, len(probe)]), 0, 1))
    assert got[0, 0] == pytest.approx(want, rel=1e-5)


def test_toxicity_learns_wording(spark):
    plain = [sentence(i, 80) for i in range(120)]
    bad = [" ".join(w if k % 9 else f"vile{'slur' if k % 2 else 'curse'}" for k, w in enumerate(sentence(1000 + i, 80).split())) for i in range(40)]
    table = docs(spark, plain + bad + [None, ""])
    labels = spark.createDataFrame([(i, 0, int(i >= 120)) for i in range(160)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(table, labels, lambda n: ~toxicity.held_out(n))
    got = {r.doc_id: r.predicted for r in toxicity.score(table, model, ["doc_id"]).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i] == (i >= 120) for i in held]) > 0.95 and got[160] == got[161] == 0


def test_mixing_targets_and_taken(spark):
    sources = {i: None if i % 7 == 0 else f"s{i % 4}" for i in range(400)}
    table = docs(spark, [None if i == 5 else sentence(i, 1 + i % 50) for i in range(400)], sources)
    got = mixing.mix(table, keep=["doc_id"]).collect()
    names = sorted({s for s in sources.values() if s}) + [None]
    size = {s: sum(r["size"] for r in got if sources[r.doc_id] == s) for s in names}
    weight, open_, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(names), {}, float(sum(size.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.remove(s)
    for s in names:
        own = [r for r in got if sources[r.doc_id] == s]
        assert own[0].target == pytest.approx(target[s]) and abs(sum(r.taken for r in own) - target[s]) <= max(30, 0.01 * target[s])
    assert all(0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] for r in got)
    assert mixing.mix(docs(spark, []), keep=["doc_id"]).count() == 0


def test_nearest_neighbours_recall(spark):
    x = np.random.default_rng(0).normal(size=(600, 16))
    odd = [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [1.0])]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table, table.vec_id % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert [k for k, _, _ in sorted(got[q])] == list(range(1, 11)) and all(abs(s[v] - c) < 1e-9 for _, v, c in got[q])
        hits += len(set(np.argsort(-s)[:10]) & {v for _, v, _ in got[q]})
    assert hits / 300 >= 0.9 and 600 not in got


def test_unigram_counts_equal_plain_dynamic_programming():
    scores = {"▁": -5.0, "▁a": -2.0, "ab": -1.5, "b": -3.0, "▁ab": -2.5, "c": -1.0}
    words = sorted({"▁ab", "▁abc", "▁abab", "▁xyz", "▁a", "▁é"})

    def plain(w):
        best = [(0.0, 0)] + [(-1e9, 0)] * len(w)
        for e in range(1, len(w) + 1):
            n = len(w[e - 1].encode())
            options = [(best[e - 1][0] - 9.0 * n, -(-best[e - 1][1] + n))] + [(best[s][0] + scores[w[s:e]], best[s][1] - 1) for s in range(e) if w[s:e] in scores]
            best[e] = max(options)
        return -best[-1][1]

    assert token_counts.forward(words, scores, -9.0, 3) == [plain(w) for w in words]


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""),
    ("<html><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two<p>Three <b>bold</b></article><div class='comments'><p>me too</p></div><footer>x</footer>", "A & B\nOne two\nThree bold"),
    ("<body><div class=sidebar>side</div><div id=main><p>Long text of the page, long enough to be the article.</p><form>q</form><script>var a='<p>';</script><p>More.</p></div><div class='cookie-notice'>ok</div></body>", "Long text of the page, long enough to be the article.\nMore."),
])
def test_html_pages(page, text):
    assert html_extract.main_text(page, None) == text


def test_wrappers_hold_slots_and_groups(spark):
    html = ["<body><nav><ul>" + "<li><a>m</a></li>" * (2 + i) + f"</ul></nav><article><h1>T{i}</h1>" + "".join(f"<p>par {i} {k}</p>" for k in range(1 + i)) + "</article><footer>same</footer></body>" for i in range(4)]
    told = html_extract.expression(html_extract.infer(html))
    assert "#slot" in told and ")+" in told and '"same"' in told
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", h) for i, h in enumerate(html)] + [(9, None, None)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert got[2] == ("T2\npar 2 0\npar 2 1\npar 2 2", 26) and got[9] == ("", 0)


def test_templates_of_one_host_do_not_empty_each_other(spark):
    def body(i, n=3):
        return "".join(f"<p>{sentence(50 * i + k, 12)}</p>" for k in range(n))

    kinds = [lambda i: f"<body><article>{body(i)}</article></body>", lambda i: f"<body><div class=story>{body(i)}</div><div class=extra>x{i}</div></body>", lambda i: f"<body><table><tr><td>{body(i)}</table></body>"]
    rows = [(i, f"http://mixed.org/{i}", kinds[min(i % 8, 2) if i % 8 < 2 else i % 2](i)) for i in range(40)] + [(40, "http://mixed.org/40", kinds[2](40))]
    rows += [(50 + i, [None, "", "no scheme"][i % 3], kinds[i % 3](50 + i)) for i in range(12)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(sentence(50 * i + k, 12) for k in range(3)) for i, _, _ in rows}


def test_constant_places_are_template_and_words_only_break_ties(spark):
    frame = {0: "<div class='page has-sidebar'>{}</div>", 1: "<form id=aspnet>{}</form>", 2: "<div class=related-content>{}</div>"}
    rows, want = [], {}
    for i in range(18):
        own = [sentence(10 * i + k, 12) for k in range(2)]
        text = f"<div class=story><p>{own[0]}</p><p>Read our paper every day of the week.</p><p>{own[1]}</p></div><div class=sidebar><p>seen {i}</p></div>"
        rows.append((i, f"http://h{i % 3}.org/{i}", "<body>" + frame[i % 3].format(text) + "</body>"))
        want[i] = "\n".join(own)
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    copies = spark.createDataFrame([(i, "http://copies.org/", rows[0][2]) for i in range(8)], "page_id long, url string, html string")
    assert all(sentence(0, 12) in r.text for r in html_extract.extract(copies).collect())


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["It's   a\n\n test's 'quoted' 12 ab12!?", None, "", "  lead", "trail  ", "x<|endoftext|>y", "naïve Straße …", "''s 's\t't", sentence(7, 3000)]
    got = sorted(token_output.token_output(docs(spark, texts), queries.tokenizer_path(), partitions=3).collect())
    at = 0
    for row, t in zip(got, texts, strict=True):
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 0]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_output.token_output(docs(spark, []), queries.tokenizer_path(), partitions=2).count() == 0


def test_elias_fano_select():
    draw = np.random.default_rng(2)
    sizes = draw.integers(0, 200, 500)
    ends = np.cumsum(sizes)
    s = token_output.Segment(token_output.pack(np.arange(ends[-1], dtype=np.uint32), ends, list(range(500))))
    assert (s.ends() == ends).all() and [s.end(k) for k in range(500)] == ends.tolist()
    assert all(len(s.document(k)) == n for k, n in enumerate(sizes))
