import functools
import hashlib
import itertools
import re
import textwrap
import time
import zlib
from html import unescape

import duckdb
import numpy as np
import pytest

from tessera.llm import common, fingerprints, html, licences, mixing, toxicity
from tests.llm.conftest import awkward_rows

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script><style>p{}</style></head><body><nav><ul><li><a href="/">Menu</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy now, today, here.</div><article><h1>A &amp; B</h1><p><b>First&nbsp;line  with\n white space.<br><p>Second, &lt;quoted&gt; &#233;.</p>'
    "<aside>See also</aside></article><footer>&copy; us</footer></body></html>"
)


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE, "A & B\nFirst line with white space.\nSecond, <quoted> é."),
        (PAGE[: PAGE.index("<aside>")], "A & B\nFirst line with white space.\nSecond, <quoted> é."),
        (None, ""),
        ("", ""),
        ("<p></p><script>x</script>", ""),
        ("<main><p>One</p><form><label>Name</label><input></form><div class='comments'><p>No, never.</p></div></main>", "One"),
        ("<body><article>x<table><tr><td>1<td>2<tr><td>3</table></article>", "x\n1\n2\n3"),
        ("<article><ul><li>a<li>b <i>c</i></ul><header><h2>t</h2></header><div id='cookie-notice'>ok</div></article><header>site</header>", "a\nb c\nt"),
        (
            "<body><div class='top'>Home About</div><div class='story'><h2>Title</h2><p>First para, with text. And more, of it.<p>Second &amp; last paragraph; with a <em>few</em> words.</div>"
            "<div><a>x</a> <a>y</a></div></body>",
            "Title\nFirst para, with text. And more, of it.\nSecond & last paragraph; with a few words.",
        ),
        ("<article>a <b title='x > y'>b</b> &unknown; &#x41</article>", "a b &unknown; A"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_pages(spark):
    rows = [(1, "u", PAGE, "extra"), (2, None, None, "e"), (1, "u", PAGE, "extra"), (3, "v", "<article>" + "<p>word, word.</p>" * 5000, "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert sorted(r["n_chars"] for r in got) == sorted(len(html.main_text(r[2])) for r in rows)
    assert html.extract(df.limit(0)).count() == 0


UNMARKED = (
    "<body><div><a href=1>Home</a> <a href=2>News</a></div><div><div><h1>Title of it</h1><p>A first paragraph, with some text in it. And more of it, to be read.</p>"
    "<ul><li>one<li>two, short<li>a <a href=x>link</a> in it</ul><blockquote><p>Quoted.</p></blockquote><table><tr><td>1<td>2</table>"
    "<section><p>Nested, in a section.</p></section><p>The last paragraph, which is also long, has commas, and ends.</p></div></div>"
    "<div><span>About</span></div><div class='cookies'><p>We use them, and more of them, for you. Do you agree, or do you, perhaps, agree?</p></div></body>"
)


def test_pages_without_marked_content():
    want = (
        "Title of it\nA first paragraph, with some text in it. And more of it, to be read.\none\ntwo, short\na link in it\nQuoted.\n1\n2\nNested, in a section.\n"
        "The last paragraph, which is also long, has commas, and ends."
    )
    assert html.main_text(UNMARKED) == want
    # A long notice does not outweigh a marked article, nor do comments in it stay.
    notice = "<div><p>" + "We store, keep, and use, all of it. " * 20 + "</p></div>"
    assert html.main_text(f"{notice}<article><p>Short one.</p><p>And two, of it.</p><div class='comments'><p>{'No, no, never. ' * 9}</p></div></article>") == "Short one.\nAnd two, of it."


def brute_ratios(page):
    """Path ratios of well-formed markup without attributes, by a stack of names."""
    stack, texts = [], {}
    for name, text in re.findall(r"<([^>]*)>([^<]*)", page):
        stack = stack[:-1] if name.startswith("/") else [*stack, name]
        if text.strip():
            texts.setdefault("/".join(stack), []).append(text.strip())
    return sorted(sum(map(len, x)) / len(x) * (1 + sum(c in ".,;:!?" for t in x for c in t) / len(x)) for x in texts.values())


def test_path_ratios():
    page = "<body><div><h1>T</h1><p>One, two.</p><p>Three; four, five!</p><ul><li>a</li><li>b, c</li></ul></div><div><p>Other</p></div><section><p>x: y</p></section></body>"
    np.testing.assert_allclose(sorted(html.path_ratios(html.Page(page).nodes).values()), brute_ratios(page))


@pytest.mark.parametrize("marked", [True, False])
def test_articles_of_the_test_pages(spark, marked):
    """Every page's article, cut out by its tags, with and without them in what is read."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        page = r["html"] if marked else re.sub(r"<(/?)article", r"<\1div", r["html"])
        assert html.main_text(page) == "\n".join(x for x in parts if x)


def test_pages_nested_deeply():
    began = time.perf_counter()
    assert html.main_text("<div>" * 100_000 + "<p>deep, text.") == "deep, text."
    assert html.main_text("<p><span>" * 30_000 + "x") == "x"
    assert time.perf_counter() - began < 20


def words_in(text):
    return len((text or "").encode().split())


def test_mixing(spark, awkward, nothing):
    got = {(r["doc_id"], r["source"]): r for r in mixing.mix(awkward).collect()}
    size = {}
    for r in awkward.collect():
        size[r["source"]] = size.get(r["source"], 0) + words_in(r["text"])
    order = sorted(k for k in size if k is not None) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    left, target, free = 1.5 * sum(size.values()), {}, set(order)
    while True:  # by rounds, as the rule is stated
        share = {k: left * weight[k] / sum(weight[j] for j in free) for k in free}
        over = [k for k in free if share[k] > 2 * size[k]]
        if not over:
            target |= share
            break
        for k in over:
            target[k] = 2 * size[k]
            free.discard(k)
        left = 1.5 * sum(size.values()) - sum(target[k] for k in target)
    taken = {}
    for r in mixing.mix(awkward).collect():
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    largest = max(words_in(r["text"]) for r in awkward.collect())
    assert all(abs(taken[k] - target[k]) <= largest for k in size)
    assert {k: (r["taken"], r["target"]) for k, r in got.items()} == {(r["doc_id"], r["source"]): (r["taken"], r["target"]) for r in mixing.mix(awkward.repartition(5)).collect()}
    assert mixing.mix(nothing).count() == 0
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(awkward.filter("doc_id <> 18")).collect()}
    rows = mixing.mixed_documents(awkward.filter("doc_id <> 18"))
    assert rows.columns == awkward.columns
    assert {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()} == {k: n for k, n in copies.items() if n}


def test_mixing_with_clashing_names(awkward):
    from pyspark.sql import functions as F

    rows = awkward.filter("doc_id <> 18")
    clash = rows.withColumns({n: F.lit(1) for n in ("full", "_source", "threshold", "__threshold", "copies", "Copy")})
    got = mixing.mixed_documents(clash)
    assert got.columns == clash.columns and got.count() == mixing.mixed_documents(rows).count()


def test_mixing_agrees_with_sql(spark):
    rows = [(i, " w" * (i * 7 % 50), None if i % 11 == 0 else f"s{i % 4 if i % 3 else 0}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    got = sorted(tuple(r) for r in mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect())
    want = sorted(con.execute(mixing.SQL).fetchall())
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    np.testing.assert_allclose([x[3] for x in got], [x[3] for x in want])


def brute_anchors(text, k=fingerprints.K, s=fingerprints.S):
    """Positions of k-mers whose least s-mer, by the same hash, stands at an edge."""
    points, _ = fingerprints.code_points([text])
    inner = [int(fingerprints.mix(fingerprints._polynomial.windows(fingerprints._polynomial.prefixes(points[i : i + s]), s))[0]) for i in range(len(points) - s + 1)]
    return [i for i in range(len(points) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]


def test_syncmers():
    text = "The quick brown fox jumps over the lazy dog; ünïcode too, again and again. " * 3
    owner, at, _ = fingerprints.anchors(["", text, "short"])
    assert sorted(at[owner == 1].tolist()) == brute_anchors(text)
    assert (owner == 0).sum() == 0 and at[owner == 2].tolist() == [0]
    moved = fingerprints.match_positions("Intro. " + text[:75], text[:75])
    assert moved and all(a - b == 7 for a, b in moved)


def brute_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def brute_hash(text):
    return sum((ord(c) + 1) * pow(common.BASE, i, 2**64) for i, c in enumerate(text)) % 2**64


@functools.cache
def brute_fingerprint(text, k=fingerprints.K, s=fingerprints.S):
    """The lowest anchor hashes by plain integers, and all of them."""
    inner = [brute_mix(brute_hash(text[i : i + s])) for i in range(len(text) - s + 1)]
    found = {text[i : i + k] for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])} or ({text} if text else set())
    every = sorted({brute_mix(brute_hash(x) ^ 0x5851F42D4C957F2D) >> 24 for x in found})
    return every[: max(fingerprints.SIZE, -(-len(every) // fingerprints.SHARE))], every


def brute_likeness(a, b):
    if not a[0] or not b[0]:
        return float(len(a[0]) == len(b[0]))
    bound = min(x[0][-1] if x[0] != x[1] else 2**64 for x in (a, b))
    x, y = ({h for h in c[1] if h <= bound} for c in (a, b))
    return len(x & y) / len(x | y)


def test_fingerprints_in_order(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    rows.sort(reverse=True)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 3, 9):
        got = {r["doc_id"]: r for r in fingerprints.fingerprint_with_next(df, parts).collect()}
        assert len(got) == len(rows)
        for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
            changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            a, b, c = (brute_fingerprint(x) for x in (t, changed, after))
            r = got[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
            assert (r["fingerprint"], r["edited_fingerprint"]) == tuple("".join(f"{h:010x}" for h in x[0]) for x in (a, b))
            assert r["near_edited"] == pytest.approx(brute_likeness(a, b)) and r["near_next"] == pytest.approx(brute_likeness(a, c))
            assert r["n_aligned"] == len(fingerprints.match_positions(t, changed))
    assert fingerprints.fingerprint_with_next(awkward).count() == awkward.count()
    assert fingerprints.fingerprint_with_next(nothing).count() == 0
    assert fingerprints.fingerprint_with_next(df.limit(1)).first()["near_next"] == 1.0


def test_likeness_near_the_truth(monkeypatch):
    import random

    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    b = a[:15_000] + "".join(rng.choice("abcdefgh ") for _ in range(9_000))
    c = "".join(rng.choice("abcdefgh ") for _ in range(30_000)) + a[:400]
    x, y, z = fingerprints.fingerprints([a, b, c])
    sets = [set(fingerprints.anchors([t])[2].tolist()) for t in (a, b, c)]
    assert len(x.hashes) > 500 and abs(fingerprints.likeness(x, y) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.05
    assert 0 < fingerprints.likeness(x, z) < 0.02
    monkeypatch.setattr(fingerprints, "SEGMENT", 777)
    assert all((p.hashes == q.hashes).all() for p, q in zip(fingerprints.fingerprints([a, "", b, c]), [x, fingerprints.fingerprints([""])[0], y, z], strict=True))
    # Texts of fewer than 2k - s code points may have no anchor, and then are their own.
    short = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in range(1, 32) for _ in range(20)]
    assert all(len(f.hashes) for f in fingerprints.fingerprints(short))
    none = fingerprints.fingerprints([""])[0]
    assert (fingerprints.likeness(none, none), fingerprints.likeness(none, x)) == (1.0, 0.0)


def brute_licences(text, templates, dice):
    low = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789\n" else " " for c in (text or "").translate(str.maketrans(licences._UPPER, licences._LOWER)))
    lines = [(i, x.split()) for i, x in enumerate(low.split("\n")) if x.split()]
    blocks = [[k for _, k in g] for _, g in itertools.groupby(((i - k, k) for k, (i, _) in enumerate(lines)), lambda x: x[0])]

    def grams(a, b):
        words = [w for _, x in lines[a : b + 1] for w in x]
        return {" ".join(x) for x in itertools.pairwise(words)} if len(words) > 1 else set(words)

    hits = []
    for name, template in templates.items():
        want = set(licences.bigrams_of(template))
        says = []
        for k, (_, words) in enumerate(lines):
            own = {" ".join(x) for x in itertools.pairwise(words + (lines[k + 1][1][:1] if k + 1 < len(lines) else []))}
            if own and 2 * len(own & want) >= len(own):
                says.append(k)
        runs = []
        for k in says:
            if runs and k - runs[-1][1] <= licences.GAP + 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        units = [(0, len(lines) - 1)] * bool(lines) + [(x[0], x[-1]) for x in blocks] + [(k, k) for k in range(len(lines))] + runs
        found = [2 * len(grams(a, b) & want) / (len(grams(a, b)) + len(want)) for a, b in units]
        if found and max(found) >= dice:
            hits.append((-max(found), name))
    return len(hits), ",".join(sorted(n for _, n in hits)), min(hits)[1] if hits else None, -min(hits)[0] if hits else None


def test_licences(spark, awkward, nothing):
    every = licences.all_templates()
    mit, bsd = licences.TEMPLATES["MIT"], licences.TEMPLATES["BSD-3-Clause"]
    three = mit.replace(": The above", ":\n\nThe above").replace("Software. THE", "Software.\n\nTHE")
    wrapped = "\n".join(textwrap.wrap(bsd, 60))
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    rows += [(900, "Intro words.\n\n" + mit.replace(". ", ".\n") + "\n\nMore."), (901, mit.replace("sublicense", "relicense")), (902, "MIT"), (903, "Licensed under CC BY 4.0.\nLICENSED UNDER CC BY-NC 4.0")]
    rows += [(904, "A long text before it, of no use.\n" * 30 + f"\nCopyright (c) me\n\n{three}\n\n" + "int main() { return 0; }\n" * 40), (905, f"words\n{wrapped}\nmore words and more of them\n" * 2)]
    rows += [(906, "something before\n\n" + every["GPL-3.0"] + "\nafter"), (907, every["Apache-2.0"].replace("\n", "\r\n")), (None, mit)]
    rows += [(910 + i, t) for i, t in enumerate(every.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, *r[1:]) for r in licences.scan(df).collect()), key=str)
    want = sorted(((i if i is not None else -1, *brute_licences(t, every, licences.DICE)) for i, t in rows), key=str)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    np.testing.assert_allclose([x[4] or 0 for x in got], [x[4] or 0 for x in want])
    best = {r[0]: r[3] for r in got}
    assert (best[904], best[905], best[906], best[907], best[-1]) == ("MIT", "BSD-3-Clause", "GPL-3.0", "Apache-2.0", "MIT")
    assert licences.scan(nothing).count() == 0 and licences.scan(awkward).count() == awkward.count()


def test_telling_words_are_in_all_that_match():
    import random

    rng = random.Random(1)
    for text in licences.all_templates().values():
        grams = licences.bigrams_of(text)
        need, telling = licences.needed(len(grams), 0.8), licences.telling_words(grams, 0.8)
        for _ in range(20):
            assert telling & {w for g in rng.sample(grams, need) for w in g.split()}


def test_kneser_ney_sums_to_one():
    words = ["abc", "abd", "xyz", "ab", "zzz", "abcab"]
    model = toxicity.train(words, np.array([[5, 0], [3, 1], [2, 0], [7, 2], [0, 4], [1, 1]], float))
    letters = sorted({c for w in words for c in w}) + [chr(toxicity.END)]
    for context in ("", "a", "ab", "z", "abcab"):
        total = np.zeros(2)
        for letter in letters:
            p = np.full(2, model.floor)
            symbols = np.array([toxicity.START, *map(ord, context), ord(letter)], np.uint32)
            prefixes = toxicity._polynomial.prefixes(symbols)
            at = np.array([len(symbols) - 1])
            for n, order in enumerate(model.orders, 1):
                if at[0] >= n - 1:
                    share, left = toxicity._looked_up(order.grams, order.shares, toxicity._key(prefixes, at, n), 0.0), toxicity._looked_up(order.contexts, order.left, toxicity._key(prefixes, at, n, 0), 1.0)
                    p = (share + left * p)[0]
            total += p
        np.testing.assert_allclose(total, 1, rtol=1e-3)


def brute_ratio(words, counts, word):
    """log p(word | toxic) - log p(word | ordinary) by plain dictionaries of strings."""
    marked = [f"^{w}$" for w in words]
    raw = [{} for _ in range(toxicity.ORDER + 1)]
    for w, both in zip(marked, counts, strict=True):
        for n in range(1, toxicity.ORDER + 1):
            for i in range(1, len(w)):
                if i - n + 1 >= 0:
                    gram = w[i - n + 1 : i + 1]
                    raw[n][gram] = [x + y for x, y in zip(raw[n].get(gram, (0, 0)), both, strict=True)]
    logs = []
    for c in (0, 1):
        held = [None] * (toxicity.ORDER + 1)
        for n in range(toxicity.ORDER, 0, -1):
            held[n] = {}
            for gram, both in raw[n].items():
                kinds = [sum(g[1:] == gram and x[k] > 0 for g, x in raw[n + 1].items()) if n < toxicity.ORDER else 0 for k in (0, 1)]
                own = [both[k] if n == toxicity.ORDER or gram[0] == "^" else kinds[k] for k in (0, 1)]
                held[n][gram] = sum(own) if n <= toxicity.SHARED_ORDER else own[c]

        def p(gram, held=held):
            if not gram:
                return 1 / max(2, len(held[1]))
            lower, n = p(gram[1:], held), len(gram)
            total = sum(x for g, x in held[n].items() if g[:-1] == gram[:-1])
            kinds = sum(x > 0 for g, x in held[n].items() if g[:-1] == gram[:-1])
            return max(held[n].get(gram, 0) - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * kinds / total * lower if total else lower

        w = f"^{word}$"
        logs.append(sum(np.log(p(w[max(0, i + 1 - toxicity.ORDER) : i + 1])) for i in range(1, len(w))))
    return logs[1] - logs[0]


def test_kneser_ney_against_plain_dictionaries():
    words = ["abc", "abd", "xyz", "ab", "zzz", "abcab", "abcabcabc", "xyzzy"]
    counts = [(5, 0), (3, 1), (2, 0), (7, 2), (0, 4), (1, 1), (2, 3), (0, 1)]
    model = toxicity.train(words, np.array(counts, float))
    asked = [*words, "q", "abq", "zz", "xyzabc", "cab"]
    np.testing.assert_allclose(model.ratios(asked), [brute_ratio(words, counts, w) for w in asked], atol=1e-4)


def test_toxicity_with_one_toxic_text(spark):
    docs, labels = toxic_table(spark, 200)
    first = next(i for i in range(0, 200, 5) if zlib.crc32(str(i).encode()) % 4 != 2)
    one = labels.filter(f"toxic = 0 OR doc_id = {first}").filter("doc_id < 1000")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, one).collect()}
    assert np.mean([scores[i] for i in scores if i % 5 == 0]) > 2 * np.mean([scores[i] for i in scores if i % 5])
    assert toxicity.calibrating({1: 0, 2: 0, 3: 1}).isdisjoint({3}) and len(toxicity.calibrating({i: i % 2 for i in range(80)})) == 20


def toxic_table(spark, n=600):
    import random

    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = " ".join(rng.choice(["blorpwit", "blorpish", "Blorper"]) if bad and k % 9 == 4 else f"{rng.choice('bcdfgm')}a{rng.choice('lnrst')}o{rng.choice('ptk')}" for k in range(40))
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (3, 0, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_on_rows_that_it_has_not_learnt_from(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) / len(held) > 0.97
    kept = {r["doc_id"] for r in toxicity.keep_ordinary(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in got if not r["predicted"]}


def test_held_out_labels_are_not_used(spark):
    docs, labels = toxic_table(spark, 300)
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_toxicity_of_awkward_tables(spark, awkward, nothing):
    docs, labels = toxic_table(spark, 300)
    model = toxicity.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_texts(awkward, model).collect()}
    assert len(scores) == len({r[0] for r in awkward_rows()}) and scores[0] == scores[3] < 0.3
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert all(r["score"] == 0 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert all(r["score"] == 0 for r in toxicity.toxicity(docs, labels.filter("toxic = 0")).collect())
