"""The parts of the operators that need no cluster, against plain versions."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest

import brute
from marquee.llm import bpe, brown, packing, simhash, substring, urls, wrapper
from marquee.llm.components import LocalForest

rng = np.random.default_rng(7)


def test_fingerprints_equal_the_plain_version():
    for text in ["", "One", "one TWO", "a b c", "É É é x " * 50, "\t lead\x0b and trail \r\n", "w " * 70_000]:
        assert simhash.fingerprint(text.encode()) == brute.fingerprint(text)


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_finds_all_near_pairs(budget):
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (60, 6), dtype=np.uint64)
    f = np.unique(np.concatenate([base, *(np.bitwise_xor.reduce(flips[:, :k], axis=1) ^ base for k in range(1, 7))]))
    whole = tuple(np.array([x]) for x in (0, f.size, 0, f.size, 0))
    found = {(int(a), int(b)) for i, j in simhash.trie_pairs(f, whole, 0, budget) for a, b in zip(i, j)}
    wanted = {(i, j) for i, j in itertools.combinations(range(f.size), 2)
              if int(f[i] ^ f[j]).bit_count() <= budget}
    assert found == wanted


def test_local_forest_joins_what_is_linked():
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    forest = LocalForest(300)
    forest.add(a, b)
    linked = set(zip(a, b)) | set(zip(b, a))
    root = brute.components(300, lambda i, j: (i, j) in linked)
    u, v = forest.edges()
    assert u.size == 300 - len(set(root))
    again = LocalForest(300)
    again.add(u, v)
    got = again.find(np.arange(300))
    assert all((got[i] == got[j]) == (root[i] == root[j]) for i in range(300) for j in range(300))


def test_optimal_buckets_have_the_least_padding():
    for _ in range(40):
        m = int(rng.integers(1, 9))
        largest = np.sort(rng.choice(np.arange(1, 60), m, replace=False))
        rows = rng.integers(1, 20, m)
        k = int(rng.integers(1, 5))

        def padding(ends):
            first, total = 0, 0
            for e in ends:
                total += sum(rows[i] * (largest[e] - largest[i]) for i in range(first, e + 1))
                first = e + 1
            return total

        best = min(padding([*cut, m - 1]) for size in range(min(k, m)) for cut in itertools.combinations(range(m - 1), size))
        got = packing.optimal_buckets(rows, rows * largest, largest, k)
        assert got[-1] == m - 1 and len(got) <= k and padding(got) == best


@pytest.mark.parametrize("alphabet", [1, 2, 50])
def test_fm_index_counts_windows(alphabet):
    parts = [rng.integers(1, alphabet + 1, int(rng.integers(35, 60))) for _ in range(12)]
    parts += [parts[0][3:40], np.concatenate([parts[1][:36], parts[2][5:41]])]
    weight = rng.integers(1, 3, len(parts))
    text = np.concatenate([np.append(p, 0) for p in parts])
    index = substring.FMIndex(text, np.repeat(weight, [p.size + 1 for p in parts]), 70)
    begin = np.cumsum([p.size + 1 for p in parts]) - [p.size + 1 for p in parts]
    starts = np.concatenate([b + np.arange(p.size - 34) for b, p in zip(begin, parts)])
    counts = {}
    for b, p, w in zip(begin, parts, weight):
        for s in range(p.size - 34):
            key = tuple(p[s:s + 35])
            counts[key] = counts.get(key, 0) + w
    wanted = np.array([counts[tuple(text[s:s + 35])] for s in starts])
    got = index.occurrences(text, starts, 35)
    assert ((got > 1) == (wanted > 1)).all() and (got[wanted > 1] == wanted[wanted > 1]).all()


def test_equal_windows_get_equal_anchors():
    words = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    h = np.concatenate([words[:200], words[50:120], words[300:], words[60:110]])
    doc = np.repeat([0, 1, 2, 3], [200, 70, 100, 50])
    first, last, anchor = substring.segments(h, doc)
    of = {}
    for a, b, g in zip(first, last, anchor):
        for w in range(a, b + 1):
            of[w] = int(g)
    valid = [w for w in range(h.size - 34) if doc[w] == doc[w + 34]]
    assert sorted(of) == valid
    by_window = {}
    for w in valid:
        assert by_window.setdefault(tuple(h[w:w + 35]), of[w]) == of[w]


def test_bpe_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    pieces = ["a", "b", "A", "É", "é", "Σ", "ς", "İ", "1", "½", "'s", "'LL", " ", "\n", "\x1c", "\x85", "中", "🙂",
              "&&&", "<|endoftext|>", "<|END", "the", "ing", "aaaa", "ab", "\t", "_", "ﬁ", "\xa0", "|", "\x00"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(0, 30)))) for _ in range(3000)]
    texts += ["", "a" * 3000, "ab" * 2000, " ", " \x85 "]
    vocabulary = bpe.Vocabulary(open(path, encoding="utf-8").read())
    got = bpe.Encoder(vocabulary).batch(pa.array([*texts, None])).to_pylist()
    assert got[-1] == []
    for text, ids in zip(texts, got):
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert " ".join(vocabulary.pieces[i] for i in ids) == library.decode(ids, skip_special_tokens=False)


def test_exchange_recovers_planted_classes():
    # words 1..20 follow each other within halves only
    n = np.zeros((21, 21), int)
    for half in (range(1, 11), range(11, 21)):
        for a in half:
            for b in half:
                n[a, b] = 5
    n[0, 1:] = n[1:, 0] = 2
    of = brown.exchange(n, 3, 0)
    assert of[0] == 0 and len(set(of[1:11])) == 1 and len(set(of[11:])) == 1 and of[1] != of[11]


def test_url_scores_tell_the_kinds_apart():
    tables = np.zeros((2, urls.ORDER + 1, 2, urls.TABLE))
    for kind, known in enumerate(([b"http://bad.com/x1", b"http://bad.com/y2"], [b"https://good.org/a", b"https://good.org/b"])):
        _, _, cells = urls._places(known)
        for k, both in enumerate(cells):
            for which, cell in enumerate(both):
                np.add.at(tables[kind, k, which], cell, 1)
    good, bad, empty = urls.score_batch([b"https://good.org/c", b"http://bad.com/z", b""], tables)
    assert good > 0 > bad and empty == 0


PAGE = ("<html><head><title>T &amp; t</title><script>var a='</p>';</script></head><body class='has-sidebar'>"
        "<header><h1>Site</h1></header><nav><ul><li><a href=/>Menu</a></ul></nav><div class=cookie-notice>Cookies</div>"
        "<article><header><h1>Head &lt;1&gt;</h1><p>by someone</p></header><p>One <b>two<br>three<p>Four&nbsp;five"
        "<aside>Side</aside><form><input>Mail</form><!-- <p>no</p> --><p>{}</article><section id=comments><p>First!"
        "</section><footer>&copy;</footer>")


def test_main_text_of_a_page():
    assert wrapper.main_text(PAGE.format("Six")) == "Head <1> One two three Four five Six"
    assert wrapper.main_text("") == wrapper.main_text("<p") .replace("<p", "") == ""
    assert wrapper.main_text("plain text &amp; more") == "plain text & more"
    assert wrapper.main_text("<div>" * 5000 + "deep") == "deep"
    assert wrapper.main_text("<article><p>a</b></i><p>b</div></article>") == "a b"


def test_no_part_of_an_article_is_lost():
    """Several article parts, text beside the article, and names that only contain a noise word."""
    cases = {
        "<main><h1>Head</h1><p class=lead>Lead</p><article><p>a</article><article><p>b</article></main>": "Head Lead a b",
        "<article><p>a</article><p>between</p><article><p>b</article>": "a b",
        "<article><div class='content has-sidebar'><p>a</div><section class=related-work><p>b</section>"
        "<p class=notice-period>c</article>": "a b c",
        "<article><header><div><h1>Head</h1><h2 class=comment-list>x</h2></div></header>a</article>": "Head a",
        "<main><header><h1>Head</h1></header><ul><li><a href='/'>link</a></ul><article>a <a href='/'>b</a></article></main>":
            "Head a b",
    }
    for page, text in cases.items():
        assert wrapper.main_text(page) == text, page


def test_articles_in_noise_are_no_article_parts():
    for noise in ("<aside>{}</aside>", "<section id=comments>{}</section>", "<div class='sidebar left'>{}</div>",
                  "<div class=related-articles>{}</div>", "<ul class='site-footer ad_slot'>{}</ul>"):
        other = noise.format("<article><p>a longer text than that of the article</p></article>")
        assert wrapper.main_text(f"<article><p>a</p></article>{other}") == "a", noise
        assert wrapper.main_text(f"<main><article><p>a</p></article>{other}</main>") == "a", noise
        assert wrapper.main_text(f"<article><p>a</p>{other}<p>b</p></article>") == "a b", noise
        assert wrapper.main_text(other) == "a longer text than that of the article", noise


def test_simple_tree_matching_finds_the_constant_nodes():
    page = "<body><div><p>{}</p><p>{}</p><p>Please subscribe</p></div><p>Imprint</p></body>"
    reader = wrapper.Reader()
    reference = page.format("x y", "z")
    root = reader.page("<body><div><p>new</p><p>Please subscribe</p></div><p>Imprint</p></body>")
    assert sorted(reader.constant(root, reference)) == [2, 3]
    assert wrapper.main_text("<body><div><p>new</p><p>Please subscribe</p></div><p>Imprint</p></body>", reference,
                             [2, 3]) == "new"


def test_long_child_lists_are_matched_for_the_greatest_total(monkeypatch):
    some = np.random.default_rng(3)
    lists = [["<p>" + "<b>x</b>" * int(k % 3) + f"t{k}</p>" for k in some.integers(0, 9, n)] for n in (40, 37, 1, 60)]
    lists[1][20:30] = lists[0][18:28]

    def total(a, b):
        forest = wrapper.Forest()
        x, y = (wrapper.parse("<div>" + "".join(p) + "</div>") for p in (a, b))
        for root in (x, y):
            forest.prune(root)
        pairs = forest._match(x.kids[0].kids, y.kids[0].kids)
        gain = sum(forest.weight(p.shape, q.shape) + (p.texts if p.hash == q.hash else 0) for p, q in pairs)
        return gain, forest.weight(x.shape, y.shape)

    cases = [(a, b) for a in lists for b in lists]
    wanted = [total(a, b) for a, b in cases]
    for cells in (8, 100):
        monkeypatch.setattr(wrapper, "MAX_CELLS", cells)
        assert [total(a, b) for a, b in cases] == wanted


def test_words_sums_and_packed_columns_equal_the_plain_versions():
    texts = ["A b\tB\x0bc\r\n", None, "", " \x1f\xa0x  É\x00 ", "a", "\n", "ß b\x0c"]
    for part in (pa.array(texts), pa.array(["zz y", *texts, "q"]).slice(1, len(texts))):
        words, sizes = brown._words(pa.RecordBatch.from_arrays([part], ["body"]))
        plain = [(t or "").encode().lower().split() for t in texts]
        assert words.cast(pa.binary()).to_pylist() == [w for each in plain for w in each]
        assert sizes.tolist() == [len(each) for each in plain]
    for top in (3, 1 << 20, 1 << 62):  # few cells, pairs that fit one number, pairs that don't
        a, b, k = rng.integers(0, top, 500), rng.integers(0, top, 500), rng.integers(1, 9, 500)
        a[250:], b[250:] = a[:250], b[:250]
        wanted = {}
        for x, y, n in zip(a.tolist(), b.tolist(), k.tolist()):
            wanted[x, y] = wanted.get((x, y), 0) + n
        got = brown.sum_up(a, b, k)
        assert list(zip(*(c.tolist() for c in got))) == [(*at, wanted[at]) for at in sorted(wanted)]
        assert (brown.unpack([brown.pack(a, b, k), brown.pack(*(c[:0] for c in (a, b, k)))], 3) == [a, b, k]).all()


def test_the_last_round_counts_no_cells_and_sorted_columns_are_stored_narrow():
    classes, pair, of_bucket = np.ones(brown.LOCAL + 1, np.int64), np.ones((48, 48)), np.ones(256, np.int64)
    near, far = np.array([[0, 1], [1, 2], [5, 6]]), np.array([[brown.FAR | 256], [2 << 1], [3]])
    for last in (False, True):
        rows = [*brown.near_step(near, classes, last),
                *brown.far_step(0, far, brown.unpack([], 3), classes, pair, of_bucket, last, 1)]
        assert (brown.CELLS in {k for r in rows for k in r.column("kind").to_pylist()}) == (not last)
    noise = rng.integers(0, 256, 10_000)
    assert len(brown.pack(noise)) < 10_100
