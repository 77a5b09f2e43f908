"""The operators' parts, against plain versions."""

from __future__ import annotations

from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import common, crf, html, induced, mixing, packing, prefixhash, simhash, suffixes, urls


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_and_common_prefixes(symbols):
    s = np.array([*symbols, 0])
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    got = induced.suffix_array(s, 5)
    assert got.tolist() == want
    common = induced.permuted_common_prefixes(s, got, 6)
    for a, b in zip(want[1:], want, strict=False):
        n = 0
        while n < 6 and max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        assert common[a] == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60))
def test_doubling_sorts_suffixes(symbols):
    s = np.array([*(x + 1 for x in symbols), 0])
    assert induced.doubled(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=90).map(str.encode), min_size=1, max_size=6))
def test_slices_cover_every_window_and_equal_windows_have_equal_names(texts):
    name, text, start, run = suffixes.slices_of(texts, 10)
    names, covered = {}, set()
    for n, t, a, r in zip(name.tolist(), text.tolist(), start.tolist(), run.tolist(), strict=True):
        for i in range(a, a + r):
            window = texts[t][i : i + 10]
            assert len(window) == 10 and names.setdefault(window, n) == n
            covered.add((t, i))
    assert covered == {(t, i) for t, x in enumerate(texts) for i in range(len(x) - 9)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=2, max_size=40, unique=True), st.integers(0, 4))
def test_bit_sliced_pairs(values, radius):
    values = np.array(values, np.int64) * 0x0101010101
    last = np.full(len(values), len(values) - 1)
    got = {(int(a), int(b)) for i, j in simhash.close_pairs(values, last, radius)
           for a, b in zip(i, j, strict=True)}
    want = {(i, j) for j in range(len(values)) for i in range(j)
            if (int(values[i]) ^ int(values[j])).bit_count() <= radius}
    assert got == want


def test_large_buckets_are_linked_through_neighbours(spark):
    values = [0, 1, 3, 7 << 40, 0xFF, 0xFE, -1, -2, 1 << 63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "value long")
    for largest in (1, 100):
        root = {r.value: r.root for r in simhash.roots(simhash.links(df, 2, largest)).collect()}
        groups = [{v for v in values if root.get(v, v) == r} for r in {root.get(v, v) for v in values}]
        assert sorted(map(sorted, groups)) == sorted(
            map(sorted, [{0, 1, 3, 1 << 62}, {7 << 40}, {0xFF, 0xFE}, {-1, -2}])
        )


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40))
def test_packed_sequences_are_full_or_powers_of_two(lengths):
    seen = [[] for _ in lengths]
    for sequence in packing.pack(lengths, (8, 16, 32, 64)):
        size = sum(n for _, _, n in sequence)
        assert size <= 64 and size & (size - 1) == 0
        for doc, start, n in sequence:
            seen[doc].append((start, n))
    for length, parts in zip(lengths, seen, strict=True):
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == length


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=5), st.integers(0, 1000))
def test_viterbi_is_the_best_of_all_sequences(slots, seed):
    rng = np.random.default_rng(seed)
    field = crf.Field(rng.normal(size=(6, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    features = np.array(slots)[:, None]

    def score(labels):
        s = field.starts[labels[0]] + sum(field.weights[f, y] for f, y in zip(slots, labels, strict=True))
        return s + sum(field.moves[a, b] for a, b in zip(labels, labels[1:], strict=False))

    best = max(product((0, 1), repeat=len(slots)), key=score)
    got = crf.viterbi(field, features, np.array([len(slots)]))
    assert np.isclose(score(tuple(got)), score(best))


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(1)
    features, labels, lengths = rng.integers(0, 4, (9, 2)), rng.integers(0, 2, 9), np.array([4, 0, 5])
    field = crf.Field(rng.normal(size=(4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    value, slope = crf.gradient(field, features, labels, lengths)
    for part in ("weights", "moves", "starts"):
        array = getattr(field, part)
        for at in np.ndindex(array.shape):
            array[at] += 1e-6
            more, _ = crf.gradient(field, features, labels, lengths)
            array[at] -= 1e-6
            assert np.isclose((more - value) / 1e-6, getattr(slope, part)[at], atol=1e-3)


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", max_size=60), st.integers(0, 50), st.integers(1, 20))
def test_span_hashes_are_equal_for_equal_spans(text, start, size):
    powers = prefixhash.Powers()
    codes = np.frombuffer((text + "xyz" + text).encode("utf-32-le"), np.uint32)
    arrays = prefixhash.Prefixes(codes, powers)
    start = min(start, len(text))
    stop = min(start + size, len(text))
    shift = len(text) + 3
    a, b = arrays.spans(np.array([start, start + shift]), np.array([stop, stop + shift]))
    assert a == b


def test_likeness():
    powers = prefixhash.Powers()
    of = lambda t: prefixhash.fingerprint(t, powers)
    text = "".join(chr(97 + (i * i * 7 + i) % 23) for i in range(900))
    assert prefixhash.likeness(of(text), of(text)) == 1 == prefixhash.likeness(of(""), of(""))
    assert 0.5 < prefixhash.likeness(of(text), of(text[:600] + "Q" * 300)) < 1
    assert prefixhash.likeness(of(text), of("Z" * 900)) < 0.1
    assert prefixhash.likeness(of(text), of("")) == 0


def test_long_unrelated_texts_are_unlike():
    rng, powers = np.random.default_rng(5), prefixhash.Powers()
    one, two = (rng.integers(97, 123, 6_000_000, np.uint8).tobytes().decode() for _ in range(2))
    assert prefixhash.likeness(*(prefixhash.fingerprint(x, powers) for x in (one, two))) < 0.01


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=16, max_size=200), st.integers(1, 60))
def test_sketch_holds_the_least_of_all_spans(text, count):
    arrays = prefixhash.Prefixes(
        np.frombuffer(text.encode("utf-32-le"), np.uint32), prefixhash.Powers()
    )
    start = np.arange(len(text) - 15)
    first, second = (arrays.short_spans(16, start, by).tolist() for by in (0, 1))
    want = sorted({a >> 32 << 16 | b >> 48 for a, b in zip(first, second, strict=True)})
    assert arrays.sketch(16, count).tolist() == want[:count]
    assert len(want) == len({text[i : i + 16] for i in start})


def test_pattern_words_are_sure_tokens():
    assert urls.words_of("||ads-track.") == ["ads", "track"]
    assert urls.words_of("/x*/banner/*foo") == ["banner"]
    assert urls.words_of("casino") == []


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, supply long")
    got = {r.source: int(r.budget) for r in mixing.budgets(leaves, 20, 1, {}).collect()}
    assert got == {"a": 10, "b": 191, "c": 201}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a <svg class='i'/> b</p><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><svg><svg><text>x</text></svg><path/>x<title/></svg><p>b</p>", ["a", "b"]),
        ("<p>a</p><svg><path d='1'><p>b</p><svg><title>x<b>x</b></title></svg>", ["a", "b"]),
        ("<div><noscript>x</div><p>a</p><div><noscript>x</noscript></div><p>b</p>", ["a", "b"]),
        ("<noscript><iframe src='x'><!-- x</noscript><p>a</p>", ["a"]),
        ("<form><select><option>x<option>x</form><p>a</p>", ["a"]),
        ("<select><option>x<select><option>x</select><p>a</p>", ["a"]),
        ("<div><object><p>x</div><p>a</p>", ["a"]),
        ("<li>a<template><li>x<template>x</template>x</li></template>b</li>", ["a", "b"]),
        ("<p>a</p><script>x</p><p>x", ["a"]),
        ("<p>a</p><textarea><p>x</textarea><p>b", ["a", "b"]),
    ],
)
def test_silent_elements_end_where_they_should(page, want):
    assert [text for text, *_ in html.blocks(page)] == want


@pytest.fixture(scope="module")
def content():
    field, numbers = html.train(), html.feature_numbers()

    def run(page):
        found = html.blocks(page)
        slots, kind = html.features(found, numbers)
        label = crf.viterbi(field, slots, np.array([len(found)]), kind)
        return [text for (text, *_), keep in zip(found, label, strict=True) if keep]

    return run


@pytest.mark.parametrize("body", ["", "no-sidebar comments-open", "cat num categories"])
@pytest.mark.parametrize(
    "wrap", ["article", "article class='cat'", "article class='num categories'", "main class='new'"]
)
@pytest.mark.parametrize("small", ["h2", "h3", "h6", "figcaption", "pre", "abbr"])
def test_names_that_training_lacks_say_nothing(content, body, wrap, small):
    long = "The river rose again last night and the old bridge was closed to all traffic."
    parts = [("h1", "Bridge closed"), ("p", long), (small, "The old bridge"), ("p", f"{long} {long}")]
    parts += [(small, "What comes next for the town"), ("p", long)]
    page = (
        f"<html><body class='{body}'><nav><ul><li><a href='/'>Home</a></li></ul></nav><{wrap}>"
        + "".join(f"<{tag}>{text}</{tag}>" for tag, text in parts if tag != "abbr")
        + "".join(f"<p><abbr>{text}</abbr></p>" for tag, text in parts if tag == "abbr")
        + f"</{wrap.split()[0]}><aside><h3>More</h3><ul><li><a href='/q'>Another</a></li></ul></aside>"
        "<footer>&copy; Site, all rights.</footer></body></html>"
    )
    want = [x for tag, x in parts if tag != "abbr"] + [x for tag, x in parts if tag == "abbr"]
    assert content(page) == want


def test_no_ancestor_is_left_out_on_a_deep_page():
    names = (*html.ASIDE_NAMES, *html.MAIN_NAMES)
    (_, place, _), = html.blocks("".join(f"<div class={n}>" for n in names) + "text")
    assert place.near | place.next | place.outer == set(names)
    assert place.near == {names[-1]} and place.next == {names[-2]}


LONG = "The river rose again last night and the old bridge was closed to all traffic."
BODY = f"<h2>Bridge closed</h2><p>{LONG}</p><p>{LONG} {LONG}</p>"
WANT = ["Bridge closed", LONG, f"{LONG} {LONG}"]


@pytest.mark.parametrize("name", html.ASIDE_NAMES)
def test_an_article_stays_one_in_any_frame(content, name):
    for page in (
        f'<div class="{name}"><article>{BODY}</article></div>',
        f'<body><div id="{name}-page"><div class="row {name}"><article>{BODY}</article></div></div>',
        f'<div class="page {name}"><nav><a href="/">Home</a></nav><main>{BODY}</main></div>',
    ):
        assert content(page) == WANT, page
    if name not in html.REPLIES:
        assert content(f'<main class="{name}-open share"><article>{BODY}</article></main>') == WANT
        assert content(f'<article class="post {name}">{BODY}</article>') == WANT


@pytest.mark.parametrize("name", html.ASIDE_NAMES)
def test_asides_of_any_name_go(content, name):
    aside = f'<div class="{name}"><h3>More of it</h3><p>{LONG}</p></div>'
    for page in (f"<article>{BODY}{aside}</article>", f"<body>{aside}<main>{BODY}</main>",
                 f"<main><article>{BODY}</article>{aside}</main>"):
        assert content(page) == WANT, page


def test_pages_without_any_name(content):
    links = "<div><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></div>"
    assert content(f"<body>{links}<div>{BODY}</div></body>") == WANT
    assert content(f"<div><div>{BODY}</div></div>") == WANT
    assert content(BODY) == WANT


def test_readers_comments_go(content):
    for name in html.REPLIES:
        other = f'<article class="{name}"><p>{LONG}</p></article>'
        assert content(f"<article>{BODY}<section>{other}{other}</section></article>") == WANT


@pytest.mark.parametrize("unit", ["<div>a", "<b>a<hr>", "<div>a</span>", "<div><input>", "<div><td>a", "<x{}>a",
                                  "<p><b>a", "<div class=w{}>a", "<li><div>a", "<a>a"])
def test_time_grows_with_the_page(unit):
    import time

    page = "".join(unit.format(i) for i in range(300_000 // len(unit)))
    start = time.process_time()
    assert html.blocks(page) or unit == "<div><input>"
    assert time.process_time() - start < 5


def test_an_unused_feature_has_no_weight(content):
    assert not html.train().weights[0].any()


def test_rows_of_one_id_are_taken_leaf_by_leaf(spark):
    rows = [(i, "one two", "en", source) for i in (None, 1, 2, 3) for source in ("src0", "src1", "src2")]
    rows += [(9, "w " * 20, "de", "src0"), (9, "one", "de", "src1"), (None, "one", "de", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for percent in (20, 50, 80, 150):
        chosen = mixing.choose(docs, percent).collect()
        want = Counter()
        for r in chosen:
            want[r.doc_id, r.lang, r.source] += r.copies
        taken = mixing.mix_documents(docs, percent=percent).collect()
        assert Counter((r.doc_id, r.lang, r.source) for r in taken) == +want
        tokens = sum(len(r.text.split()) for r in taken)
        assert tokens == sum(r.n_tokens * r.copies for r in chosen) <= percent * 47 / 100


def test_each_text_of_an_id_has_its_own_cuts_and_component(spark):
    shared = "".join(chr(97 + (i * i * 7 + i) % 23) for i in range(120))
    other = "".join(chr(65 + (i * i * 5 + i) % 26) for i in range(300))
    rows = [(1, f"first {shared}"), (2, shared + "!" + other), (2, other[::-1] + "?" + shared),
            (2, other[::-1] + "?" + shared), (2, "short"), (3, other[:100])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.kept) for r in suffixes.remove_repeats(docs, as_text=True).collect())
    kept = [f"first {shared}", "!" + other, other[::-1] + "?", other[::-1] + "?", "short", ""]
    assert got == Counter((i, len(x), y) for (i, x), y in zip(rows, kept, strict=True))
    firsts = [(r.doc_id, r.text) for r in simhash.keep_first(docs).collect()]
    assert sorted(firsts) == sorted(set(rows))


def test_rows_without_an_id_spread_over_blocks(spark):
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(200)], "doc_id long, text string")
    rows = common.pack_blocks(docs, "doc_id", 7).collect()
    assert {r.shard for r in rows} == set(range(7))
    assert sum(common.unpack_batch(r.payload).num_rows for r in rows) == 200
    left = suffixes.remove_repeats(docs, as_text=True).collect()
    assert {r.kept for r in left} == {f"text {i}" for i in range(200)}
