"""Operators against brute force on small tables with nulls, ties, repeats, empty and long texts and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import bpe, embeddings, exact, gsaca, langid, mixing, secrets, shingles, simhash, suffix, toxicity, wrappers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", " \t", "a", "A", "x y", "x\n y", "Ünï cödé ﬁ", passage, passage + " tail", "long " * 4000]
    for _ in range(30):
        t = " ".join(word() for _ in range(rng.randint(1, 120)))
        texts += [t, t.replace(" ", "  ", 1), t + " " + word(), word() + passage + word() + t]
    rng.shuffle(texts)
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), 1, 7, "k", 9) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def by(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact(docs, rows):
    got, groups = by(exact.exact_dedup(docs)), {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    for ids in groups.values():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(ids), len(ids), i == min(ids))


def test_exact_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "z")], "doc_id long, text string")
    got = sorted(((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_dedup(df).collect()), key=repr)
    assert got == [("1", 1, 3, True), ("1", 1, 3, True), ("None", 1, 3, False), ("None", None, 1, True)]
    assert exact.exact_dedup(df.limit(0)).count() == 0


def _fingerprint(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _reach(n, links):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return root


def test_simhash(docs, rows):
    fp = [_fingerprint(r[1]) for r in rows]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    root, got = _reach(len(fp), links), by(simhash.simhash_dedup(docs))
    assert {i: (got[i]["fp"] % (1 << 64), got[i]["component_id"]) for i in got} == {i: (fp[i], root[i]) for i in range(len(fp))}


@pytest.mark.parametrize("trees", [1, 2, 3, 5])
def test_forests_agree(spark, trees, monkeypatch):
    """Few bits are used, so that boundaries matter; blocks are small, so that shards are dealt as pairs."""
    rng = np.random.default_rng(trees)
    fp = np.unique(rng.integers(0, 1 << 20, 300).astype(np.int64) * ((1 << 44) + 1))
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fp)], "id long, fp long")
    monkeypatch.setattr(simhash, "BLOCK", 8)
    links = [(i, j) for i in range(len(fp)) for j in range(i) if ((int(fp[i]) ^ int(fp[j])) & ((1 << 64) - 1)).bit_count() <= 4]
    root, got = _reach(len(fp), links), by(simhash.near_components(df, 4, trees), "fp")
    assert {x: got[x]["component_id"] for x in got} == {int(x): root[i] for i, x in enumerate(fp)}


def test_secrets():
    assert secrets.base_spans("token=abc token: token:abcdef AKIA" + "A" * 16 + " " + "0f" * 12) == [(30, 50, "access"), (51, 75, "hex")]  # the first match takes "token: token"
    text = 'x password = "hunter22" ' + "AKIA" + "B" * 16 + " " + "ab" * 20 + " secret:abc"
    kinds = [k for _, _, k in secrets.secret_spans(text)]
    assert kinds == ["assign", "access", "hex"]
    import base64

    head = base64.urlsafe_b64encode(b'{"alg":"HS256","typ":"JWT"}').decode().rstrip("=")
    assert [k for *_, k in secrets.secret_spans(f"a {head}.e30eeeee.sig b")] == ["jwt"]
    key = b"\x02\x01\x00" + b"\x02\x20" + bytes(range(1, 33))
    der = base64.b64encode(b"\x30" + bytes([len(key)]) + key).decode()
    assert [k for *_, k in secrets.secret_spans(f"see {der} there")] == ["der"]
    assert secrets.secret_spans("see " + der[:-9] + "AAAA there") == []
    ssh = base64.b64encode(b"\0\0\0\x0bssh-ed25519\0\0\0\x20" + bytes(32)).decode()
    assert [k for *_, k in secrets.secret_spans(ssh)] == ["openssh"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_secrets_wrapped(end):
    """PEM bodies of all lengths modulo 48, padded or not, and one-line keys before a word."""
    import base64

    wrap = lambda s, k=64: end.join(s[i : i + k] for i in range(0, len(s), k))
    for k in range(100, 350):
        body = b"\x02\x01\x00\x04" + (bytes([k - 20]) if k < 148 else b"\x81" + bytes([k - 20]) if k < 276 else b"\x82" + (k - 20).to_bytes(2, "big")) + bytes((7 * i) % 251 for i in range(k - 20))
        size = bytes([len(body)]) if len(body) < 128 else b"\x81" + bytes([len(body)]) if len(body) < 256 else b"\x82" + len(body).to_bytes(2, "big")
        der = base64.b64encode(b"\x30" + size + body).decode()
        for key in (wrap(der), der):
            for bare in (key, key.rstrip("=")):
                for before, after in ((f"-----BEGIN PRIVATE KEY-----{end}", f"{end}-----END PRIVATE KEY-----"), ("see ", f"{end}next"), ("", ""), ("", f"{end}AB there")):
                    text = before + bare + after
                    assert [(a, b) for a, b, t in secrets.secret_spans(text) if t == "der"] == [(len(before), len(before) + len(bare))], text
        assert [t for *_, t in secrets.secret_spans(der.rstrip("=") + "AAAA") if t == "der"] == []
        part = lambda b: len(b).to_bytes(4, "big") + b
        ssh = wrap(base64.b64encode(b"openssh-key-v1\0" + part(b"none") * 2 + part(b"") + b"\0\0\0\1" + part(bytes(51)) + part(bytes(k))).decode(), 70)
        for bare in (ssh, ssh.rstrip("=" + end)):
            assert [(a, b) for a, b, t in secrets.secret_spans(f"-----BEGIN OPENSSH PRIVATE KEY-----{end}{bare}{end}-----END") if t == "openssh"] == [(35 + len(end), 35 + len(end) + len(bare))]


def test_secrets_table(docs, rows):
    got = by(secrets.scan_secrets(docs))
    assert {i: len(got[i]["spans"]) for i in got} == {r[0]: len(secrets.secret_spans(r[1] or "")) for r in rows}


def test_targets():
    t = mixing.targets([("b", 100), ("a", 10), (None, 50)])
    assert t["a"] == 20 and abs(sum(t.values()) - 240) < 1e-9 and t["b"] <= 200 and t[None] <= 100


def test_mix(spark, docs, rows):
    got = by(mixing.mix(docs))
    again = by(mixing.mix(docs.repartition(5)))
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert {i: got[i]["size"] for i in got} == size
    assert {i: got[i]["taken"] for i in got} == {i: again[i]["taken"] for i in again}
    for s in ("a", "b", None):
        own = [r[0] for r in rows if r[3] == s]
        assert all(0 <= got[i]["taken"] <= 2 * size[i] for i in own)
        assert abs(sum(got[i]["taken"] for i in own) - got[own[0]]["target"]) <= max(size[i] for i in own)


def test_mix_many(spark):
    """Several rounds of blocks; sizes tie."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), F.col("id").cast("int") % 7)).alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    r = mixing.mix(df).groupBy("target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(x["t"] - x["target"]) <= 12 for x in r)


def test_language(docs, rows):
    model = langid.fit(docs.where(langid.training()))
    got = by(langid.identify(docs, model))
    assert len(got) == len(rows) and all(g["lang_pred"] in ("en", "fr", "und") and 0 <= g["score"] <= 1 for g in got.values())
    assert all((got[r[0]]["lang_pred"] == "und") == (not any(c.isalpha() for c in r[1] or "")) for r in rows)


def test_language_astral():
    model = langid.Mixture(["aa", "bb"], np.ones((2, langid.CELLS)))
    assert model.proportions(chr(0x1E922) * 5) and model.proportions(chr(0x10330) * 5) and model.proportions(chr(0x20000))
    assert model.proportions("".join(map(chr, range(0x1F900, 0x1FA00)))) == {}


def test_language_held_out(spark):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(20))
    df = spark.createDataFrame([(i, make("abcdef" if i % 2 else "uvwxyz"), "p" if i % 2 else "q") for i in range(200)], "doc_id long, text string, lang string")
    model = langid.fit(df.where(langid.training()))
    assert all(r["lang_pred"] == ("p" if r["doc_id"] % 2 else "q") for r in langid.identify(df.where(~langid.training()), model).collect())
    both = model.proportions(make("abcdef") + " " + make("uvwxyz"))
    assert set(both) == {"p", "q"} and abs(both["p"] - 0.5) < 0.1
    empty = langid.fit(df.limit(0))
    assert empty.proportions("abc") == {}


def _dense(idf, rows):
    """Unit vectors of rows of term counts."""
    x = np.zeros((len(rows), len(idf)))
    for i, counts in enumerate(rows):
        for t, n in counts.items():
            x[i, t] = (1 + np.log(n)) * idf[t]
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    idf, rows = rng.random(300) * 4 + 0.1, []
    for _ in range(900):
        own = rng.choice(300, rng.integers(1, 40), replace=False, p=(p := 1 / np.arange(1, 301)) / p.sum())
        rows.append({int(t): int(rng.integers(1, 4)) for t in sorted(own)})
    rows += rows[:50]
    flat = lambda rows: (np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.array([t for r in rows for t in r], "<i4"), np.array([n for r in rows for n in r.values()], "<i4"))
    index = toxicity.BlockMaxIndex(idf, *flat(rows), np.arange(len(rows)), np.arange(len(rows)) % 7 == 0)
    assert index.whole.shape[1] and len(index.entry) and len(index.id) < len(rows)
    x = _dense(idf, rows)
    own = x[index.id]
    for i, (entries, cosine) in enumerate(index.nearest(*flat(rows))):
        all_ = np.round(own @ x[i], 12)
        want = np.lexsort((index.id, -all_))[:16]
        assert np.allclose(cosine, all_[want][all_[want] > 0], atol=1e-9)
        assert sorted(index.id[entries]) == sorted(index.id[want[all_[want] > 0]]) or np.isclose(all_[want[-1]], np.sort(all_)[-17])


@pytest.mark.parametrize("clash", [False, True])
def test_names(monkeypatch, clash):
    """Terms are found by hashes, also if two of them share one and a word without a term does."""
    if clash:
        monkeypatch.setattr(toxicity, "_hashes", lambda words: np.array([len(w or "") for w in words.to_pylist()], np.int64))
    known = ["^abcde", "a", "abcdef", "bb", "\u00e9t\u00e9"]
    names = toxicity.Names(pa.array(known))
    words = ["bb", None, "cc", "a", "abcdef", "", "\u00e9t\u00e9", "^abcde", "^abcdf"]
    assert names.clash == clash and names.find(pa.array(words)).tolist() == [known.index(w) if w in known else -1 for w in words]
    assert toxicity.Names(pa.array(["a", "bb"])).find(pa.array(["b", "bb", "a"])).tolist() == [-1, 1, 0]
    assert toxicity.Names(pa.array([], pa.string())).find(pa.array(words)).tolist() == [-1] * len(words)
    begin, at, n = toxicity.term_counts(["abcdef bb  BB x", "", "abcdexyz"], names)
    assert (begin.tolist(), at.tolist(), n.tolist()) == ([0, 3, 3, 4], [0, 2, 3, 0], [1, 1, 2, 1])


def test_rows_of_blocks():
    """Blocks of one vocabulary keep no rows of another's terms, and a term that they hold seldom has postings; cosines stay exact in any mix of texts."""
    rng = np.random.default_rng(5)
    idf, rows = rng.random(400) + 0.5, []
    for i in range(1024):
        own = np.concatenate([np.arange(40), rng.choice(np.arange(40, 200), 20, replace=False)]) + 200 * (i % 2)
        rows.append({int(t): int(rng.integers(1, 4)) for t in sorted({*own, *(rng.choice(400, 2) if i % 10 == 0 else ())})})
    flat = lambda rows: (np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.array([t for r in rows for t in r], "<i4"), np.array([n for r in rows for n in r.values()], "<i4"))
    index = toxicity.BlockMaxIndex(idf, *flat(rows), np.arange(len(rows)), np.arange(len(rows)) % 7 == 0)
    assert 0 < index.whole.size <= 0.7 * index.blocks * toxicity.BLOCK * len(index.most) and len(index.post)
    own = _dense(idf, rows)[index.id]
    asked = [{}, *rows[:600], {3: 2, 390: 1}]
    found = index.nearest(*flat(asked))
    assert len(found) == len(asked) and not len(found[0][0])
    for x, (entries, cosine) in zip(_dense(idf, asked)[1:], found[1:], strict=True):
        all_ = np.round(own @ x, 12)
        assert np.allclose(cosine, np.sort(all_)[::-1][:16], atol=1e-9) and np.allclose(all_[entries], cosine, atol=1e-9)


def test_postings_in_parts(monkeypatch):
    """Postings that are added up in several parts give the same scores."""
    rng = np.random.default_rng(8)
    idf = rng.random(500) + 0.5
    begin, at = np.arange(301) * 30, np.concatenate([np.sort(rng.choice(500, 30, replace=False)) for _ in range(300)]).astype("<i4")
    n = np.ones(len(at), "<i4")
    want = toxicity.BlockMaxIndex(idf, begin, at, n, np.arange(300), np.zeros(300, bool)).nearest(begin, at, n)
    monkeypatch.setattr(toxicity, "POSTINGS", 7)
    index = toxicity.BlockMaxIndex(idf, begin, at, n, np.arange(300), np.zeros(300, bool))
    assert len(index.steps) < 100
    assert all(a.tolist() == c.tolist() and b.tolist() == d.tolist() for (a, b), (c, d) in zip(want, index.nearest(begin, at, n), strict=True))


def test_words_and_frequencies():
    """Words cut by code points are those of the expression, whatever the letters; frequencies count an example once."""
    word = re.compile(r"\w+")
    texts = ["\u0130stanbul \u039f\u0394\u039f\u03a3 \u03a3 x_1 \u00bd\u00b2 \U0001e922\U00010330 a\u0301b", "", "\n\n", "one\ntwo \U0001f600three", "".join(map(chr, [*range(0x3000), *range(0xFE00, 0x11000)]))]
    row, said = toxicity._words(texts)
    assert list(zip(row.tolist(), said.to_pylist(), strict=True)) == [(i, w) for i, t in enumerate(texts) for w in word.findall(t.lower())]
    assert toxicity._words([])[1].to_pylist() == toxicity._words(["", " "])[1].to_pylist() == []
    examples = [(1, "abcdef abcdef bb"), (0, "Abcdexyz bb, bb"), (1, ""), (0, "\u00e9t\u00e9s\u00e9t\u00e9s")]
    batch = pa.RecordBatch.from_arrays([pa.array([*range(4)]), pa.array([y for y, _ in examples], pa.int32()), pa.array([t for _, t in examples])], names=["id", "y", "t"])
    want = {}
    for y, t in examples:
        words = word.findall(t.lower())
        for term in {*words, *("^" + w[:5] for w in words if len(w) > 5)}:
            n, toxic = want.get(term, (0, 0))
            want[term] = n + 1, toxic + y
    got = [r for b in toxicity._term_frequencies(iter([batch])) for r in b.to_pylist() if r["term"] is not None]
    assert {r["term"]: (r["n"], r["toxic"]) for r in got} == want and len(got) == len(want)
    assert [r for b in toxicity._term_frequencies(iter([batch.slice(2, 1)])) for r in b.to_pylist()] == []


def test_toxicity(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["tree", "house", "river", "cloud"]) for _ in range(20)) + (" vile" if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows] + [(7, None), (5000, 1)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels.where(langid.training()))
    got = by(toxicity.score(docs, index))
    assert all((got[i]["score"] >= 0.3) == (i % 5 == 0) for i, _ in rows) and got[1000]["score"] < 0.3
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r["score"] == 0 for r in toxicity.score(docs, none).collect())


def test_toxicity_rare_wording(spark):
    """A near copy of a labelled text is found though no term of it recurs among toxic examples."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(30))) for i in range(300)]
    docs = spark.createDataFrame([*rows, *[(1000 + i, t + " tail") for i, t in rows[:40]], (2000, "unseenword")], "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    got = by(toxicity.score(docs, index))
    assert all((got[1000 + i]["score"] >= 0.3) == (i % 5 == 0) and got[1000 + i]["evidence"][0]["id"] == i for i in range(40))
    assert got[2000]["evidence"] == []


def test_pages(spark):
    layout = "<html><body><div class='top'>Site name</div><div class='x'><h1>{0}</h1><p>Body {0} of some length &amp; more<p>and<br>more</div><div>All rights</div><form>find</form></body></html>"
    rows = [(i, f"http://h.example/{i}", layout.format(f"t{i}" * 9)) for i in range(6)]
    rows += [(10, "http://one.example", "<nav>menu</nav><article><h1>A&nbsp;b</h1><p>c <b>d</b>e<script>x</script></article><footer>f"), (11, None, None), (12, "u", "")]
    got = by(wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert got[3]["text"] == f"{'t3' * 9} Body {'t3' * 9} of some length & more and more"
    assert (got[10]["text"], got[11]["text"], got[12]["text"]) == ("A b c de", "", "")


def test_pages_template(spark):
    """What repeats over a host inside article goes, wherever it stands; copies and lone pages keep their text."""
    page = lambda i, k: "<html><body><article><h1>Title {0}</h1>{1}<div class='x'>Read our offers</div>{2}<section class='y'><p>Support us today</p></section></article></body></html>".format(i, f"<p>lead {i}</p>" * (i % 3), "".join(f"<p>Body {i} {j} of some length</p>" for j in range(k)))
    rows = [(i, f"http://h.example/{i}", page(i, 2 + i % 4)) for i in range(8)] + [(8, "http://h.example/8", page(7, 2 + 7 % 4))]
    rows += [(20 + i, f"http://copy.example/{i}", page(5, 3)) for i in range(3)] + [(30, "http://one.example/", page(1, 2))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = by(wrappers.extract(df), "page_id")
    for i in range(9):
        k = min(i, 7)
        assert got[i]["text"] == " ".join([f"Title {k}", *[f"lead {k}"] * (k % 3), *[f"Body {k} {j} of some length" for j in range(2 + k % 4)]])
    assert all("Support us today" in got[i]["text"] for i in (20, 21, 22, 30))
    assert {r["wrapped"]: r["pages"] for r in wrappers.decided(df).collect()} == {True: 9, False: 4}


def test_pages_names():
    """Boilerplate names of several words go, on lone pages too; names of the article itself stay."""
    bad = "ad-slot cookie-banner sidebar-left post-comments comments-area related-posts site-header postComments siteHeader left_sidebar AdSlot"
    good = "post-header entry-header article-header content-with-sidebar has-sidebar no-ads ad-free comments-free share-text header-less page-content widget-wrapper adagio shared"
    for names, keeps in ((bad, False), (good, True)):
        for name in names.split():
            for page in ("<article><p>One</p><div class='{}'>two</div></article>", "<p>One</p><div id='{}'>two</div>"):
                assert wrappers.Page(page.format(name)).text()[0] == ("One two" if keeps else "One"), name
    assert wrappers.Page("<body class='ads-on'><article class='post sponsor-post'><p>One</p></article></body>").text()[0] == "One"


def test_tree_match():
    a, b = wrappers.Page("<ul><li>1<li>2</ul><p>x").tree(), wrappers.Page("<ul><li>1<li>2<li>3</ul><div>y</div><p>x").tree()
    assert len(wrappers.match(a, b)) == 5


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings(spark, block, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 64))
    x = np.concatenate([base, base + 0.1 * rng.standard_normal((40, 64)), base + 0.14 * rng.standard_normal((40, 64)), base[:5], base[:1] + 0.08 * rng.standard_normal((60, 64))]).astype(np.float32)
    rows = [(i, v.tolist(), i % 3 if i < 120 else 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, x[0].tolist(), None), (904, [1.0, None], 0), (905, [], 1)]
    monkeypatch.setattr(embeddings, "BLOCK", block)
    got = by(embeddings.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), "vec_id")
    n = len(x)
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    lab = np.array([r[2] for r in rows[:n]])
    near = (u @ u.T >= 0.98) & (lab[:, None] == lab[None]) & ~np.eye(n, dtype=bool)
    root = _reach(n, list(zip(*np.nonzero(near), strict=True)))
    assert near.sum() > 100
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in range(n)} == {i: (near[i].sum(), root[i]) for i in range(n)}
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in range(900, 906))


def test_embeddings_extreme(spark):
    """Vectors whose squares overflow or vanish link as others do."""
    rows = [(0, [1e200, 1e200], 0), (1, [1.0, 1.0], 0), (2, [1e-200, 0.0], 0), (3, [5.0, 0.1], 0), (4, [5e-324, 0.0], 0), (5, [-1.0, -1.0], 0)]
    got = by(embeddings.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id")
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {0: (1, 0), 1: (1, 0), 2: (2, 2), 3: (2, 2), 4: (2, 2), 5: (0, 5)}


def test_across_tries():
    """A few partners are the first of a text's own order; without a bound all pairs of unlike components are there."""
    n = 40
    zero = [pa.array(np.zeros(n, np.int64))] * 4
    cols = [np.full(n, 7), np.full(n, 20), np.arange(n) * 11 + 1, np.zeros(n), np.r_[np.zeros(30), np.arange(1, 11)]]
    batch = pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int64)) for c in cols], *zero], names=["token", "n", "node", "at", "root", *shingles._ODD])
    told = lambda tries: {p for b in shingles._across(tries)([batch]) for p in zip(*b.to_pydict().values(), strict=True)}
    every, few = told(None), told(3)
    root = dict(zip(cols[2].tolist(), cols[4].tolist(), strict=True))
    assert every == {(a, b) for a in root for b in root if a < b and root[a] != root[b]}
    assert few < every and len(few) <= 30 and few == told(3)


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(500):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))] + [0]
        assert gsaca.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("hot", [256, 1])
def test_passages(spark, docs, rows, hot):
    extra = spark.createDataFrame([(500, "z" * 400), (501, "z" * 300 + "q" * 60), (502, "q" * 55), (None, "z" * 80)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(extra)
    all_ = [(r["doc_id"], (r["text"] or "").encode()) for r in table.collect()]
    first = {}
    for i, b in sorted(all_, key=lambda x: (x[0] is None, x[0])):
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    got = by(suffix.suffix_dedup(table, hot=hot))
    for i, b in all_:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] != i:
                gone[s : s + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(b), gone.sum(), spans, bytes(np.frombuffer(b, np.uint8)[~gone]))


def test_bpe(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, got = Tokenizer.from_file(path), by(bpe.encode_decode(docs, path))
    for i, t, *_ in rows:
        want = library.encode(t or "", add_special_tokens=False)
        assert (got[i]["ids"], got[i]["decoded"]) == (want.ids, library.decode(want.ids, skip_special_tokens=False))


def test_bpe_unicode():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.TrieEncoder(path)
    for c in [*range(1, 0x200), *range(0x200, 0x3000, 7), 0x1F600, 0x3A3, 0x130]:
        word = f"a{chr(c)}B<|endoftext|>1's{chr(c)}"
        if not word.isascii() and not any(x.isspace() for x in word):
            assert np.frombuffer(own.chunks([word.encode()])[0], "<i4").tolist() == library.encode(word, add_special_tokens=False).ids


def _five(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_stage(spark, docs, rows):
    """Copies with edited words, chains of them, a passage that many texts share, null and repeated ids."""
    import corpus_pipeline as P

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts, passage = [r[1] for r in rows], [word() for _ in range(30)]
    for _ in range(12):
        t = [word() for _ in range(rng.randint(40, 300))]
        texts.append(" ".join(t))
        for _ in range(5):
            t = t.copy()
            for _ in range(max(1, len(t) // 60)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [" ".join(passage + [word() for _ in range(k)]) for k in range(3, 40)]
    table = [(None if i % 17 == 0 else i - i % 2, t) for i, t in enumerate(texts)]
    sets = [_five(t) for _, t in table]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = _reach(len(sets), links)
    want = {}
    for i, (d, t) in enumerate(table):
        want.setdefault(root[i], []).append((d is None, d or 0, t or ""))
    got = P.near_copies(spark, spark.createDataFrame(table, "doc_id long, text string").repartition(3), "").collect()
    assert len(links) > 100 and len({norm(r["text"]) for r in got}) <= len(got)
    left = {}
    for r in got:
        group = next(root[i] for i, (d, t) in enumerate(table) if (t or "") == (r["text"] or ""))
        left.setdefault(group, set()).add(r["text"] or "")
    assert {g: len(t) for g, t in left.items()} == {g: 1 for g in want}
    assert all(min(want[g])[:2] in {x[:2] for x in want[g] if x[2] in t} for g, t in left.items())


def test_bpe_composed(spark):
    """Capitals that compose with a mark only in lower case, whole and within words."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, pairs = Tokenizer.from_file(path), ["H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c"]
    texts = [*pairs, *[f"aB{p}C <|endoftext|> {p}{p.lower()} PLAIN" for p in pairs], " ".join(pairs)]
    got = by(bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path))
    for i, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False)
        assert (got[i]["ids"], got[i]["decoded"]) == (want.ids, library.decode(want.ids, skip_special_tokens=False))


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline as P

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    letters = {r[0]: r[1] for r in rows if any(c.isalpha() for c in r[1] or "")}
    seen, kept = set(), []
    for i in sorted(letters):
        if norm(letters[i]) not in seen:
            seen.add(norm(letters[i]))
            kept.append(i)
    fp = [_fingerprint(letters[i]) for i in kept]
    root = _reach(len(kept), [(i, j) for i in range(len(kept)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    kept = [i for k, i in enumerate(kept) if root[k] == k]
    assert {r["doc_id"] for r in got} <= set(kept)
    size = sum(len(re.findall(r"[^\x20\x09-\x0D]+", letters[i])) for i in kept)
    longest = max(len(re.findall(r"[^\x20\x09-\x0D]+", letters[i])) for i in kept)
    took = sum(len(re.findall(r"[^\x20\x09-\x0D]+", letters[r["doc_id"]])) for r in got)
    assert abs(took - 1.5 * size) <= 3 * longest
    assert hashlib.sha256(b"").hexdigest() not in {r["decoded_sha256"] for r in got}


def test_stages_edges(spark):
    """Clashing columns, null ids, shared ids, repeated rows and empty tables in every stage."""
    import corpus_pipeline as P

    extra = "_gone string, _id int, _copies int, _copy int, _size int, _digest string, _text string, id int, key string, node int"
    long = "the river runs by the old mill and over the weir to the sea"
    texts = [(1, long), (1, long), (None, long), (2, long + " today"), (2, "another text that has no copy here"), (None, "lone text without any id at all"), (3, None), (4, ""), (5, "1234")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, *[None] * 10) for i, t in texts], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    told = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    left = P.language(spark, docs, "")
    assert left.columns == docs.columns and told(left) == sorted([t for t in texts if t[1] and t[1] != "1234"], key=repr)
    left = P.exact_copies(spark, docs, "")
    assert told(left) == sorted([t for t in texts if t not in ((None, long), (4, ""))], key=repr)
    assert (None, "lone text without any id at all") in told(P.near_copies(spark, docs, ""))
    mixed = P.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count() >= 4
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in P.encode(spark, docs, "").collect()}[4] == 0


def test_sketches():
    """A sketch never rules out a pair that is similar."""
    rng = np.random.default_rng(5)
    hits = 0
    for n in (1, 2, 9, 40, 300, 3000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        for share in (0, 0.05, 0.1, 0.12, 0.3, 1):
            k = int(len(a) * share)
            b = np.unique(np.concatenate([a[k:], rng.integers(-(1 << 62), 1 << 62, k // 2)]))
            if not len(b):
                continue
            may = shingles.may_be_similar(len(a), shingles.sketch(a), len(b), shingles.sketch(b))
            hits += not may
            assert may or not shingles.similar(a, b)
    assert hits


def test_parities():
    """Sets that the parities tell apart are never similar, whatever share of their hashes they have in common."""
    rng, ruled = np.random.default_rng(5), 0
    for _ in range(2_000):
        n, alone = int(rng.integers(1, 400)), int(rng.integers(0, 60))
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate([a[: max(1, len(a) - alone)], rng.integers(-(1 << 62), 1 << 62, alone)]))
        gone = shingles.apart(np.array([len(a)]), shingles.parities(a)[None], len(b), shingles.parities(b))[0]
        assert not (gone and shingles.similar(a, b))
        ruled += gone
    assert ruled > 200
