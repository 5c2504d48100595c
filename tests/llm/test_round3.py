"""SuperMinHash, spelling variants and the Merkle manifest against brute force, and words that a polynomial hash can't tell apart."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brookwell.llm import merkle, nearjoin, quality, spelling, substrings, superminhash
from brookwell.llm import wordhash as wh
from brookwell.llm.queries import LOWER, QUERIES, UPPER

SF = "/root/testdata/sf0.001"
CLASH = ["id", "key", "order", "leaf", "rank", "block", "rows", "at", "part", "word", "n", "bands", "size", "text_hash", "found", "root"]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH})


WORDS = " ".join(f"w{i}" for i in range(60))
ODD = [(1, None), (None, "a b"), (2, ""), (3, WORDS), (3, WORDS), (4, WORDS + " and more"), (5, "A b"), (None, None), (6, " \t\n"), (7, "x " * 3000), (8, "É é à"), (9, WORDS.upper())]


# Words of two letters that agree in every polynomial modulo 2**64 with an odd base


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("length", [1024, 4096])
def test_thue_morse_words_are_told_apart(spark, length):
    a, b = thue_morse(length, "ab"), thue_morse(length, "ba")
    rest = " ".join(f"r{i}" for i in range(34))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    assert ordered(substrings.remove_repeats(docs).collect()) == ordered(substrings.brute_force(rows)) and substrings.brute_force(rows)[0][2] == 0
    short = [(1, f"{a} q w e r"), (2, f"{b} q w e r")]
    got = nearjoin.near_duplicates(spark.createDataFrame(short, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect()
    assert ordered(got) == ordered(nearjoin.brute_force(short)) == [(1, 1, 0), (2, 2, 0)]
    one = spark.createDataFrame([(1, f"{a} q w x {b} q w y", "s")], "doc_id long, text string, source string")
    assert quality.assess(one).first().n_repeat_words == 0


def test_word_hashes_depend_on_every_byte_and_on_the_key():
    words = ["a", "b", "aa", "é", "abcdefgh", "abcdefghi", "abcdefghj", "x" * 300, "x" * 299 + "y", "x" * 256, "x" * 257]
    for _, data, offsets in wh.slices(pa.array([" ".join(words)])):
        starts, ends, _ = wh.words(data, offsets)
        found = [*wh.word_hashes(data, starts, ends).tolist(), *wh.word_hashes(data, starts, ends, wh.OTHER_KEY).tolist()]
        assert len(set(found)) == 2 * len(words)


# 11: SuperMinHash


def brute_components(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    split = [(t or "").translate(str.maketrans(UPPER, LOWER)).encode().split() for _, t in rows]
    sets = [{tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set() for w in split]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = label[i], label[j]
                label = [min(x, y) if z in (x, y) else z for z in label]
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[label[i]] = min(d, names.get(label[i], d))
    return [(d, len(sets[i]), names.get(label[i]), d == names.get(label[i])) for i, (d, _) in enumerate(rows)]


def test_components_match_brute_force(spark):
    near = [(20 + i, " ".join(f"q{j if j != 3 * i else 'x'}" for j in range(60))) for i in range(12)]
    chain = [(50 + i, " ".join(f"c{j}" for j in range(3 * i, 3 * i + 60))) for i in range(8)]
    rows = ODD + near + chain + [(99, "long " + " ".join(f"l{i}" for i in range(60_000)))]
    for blocks in ({}, {"block": 3}):
        assert ordered(superminhash.near_duplicates(docs_of(spark, rows), **blocks).collect()) == ordered(brute_components(rows))
    assert superminhash.near_duplicates(docs_of(spark, ODD).limit(0)).collect() == []


def test_components_over_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(QUERIES["op11_superminhash"](spark, SF).collect()) == ordered(brute_components(rows))


def test_ranks_are_permutations_and_vary_less_than_min_hashes():
    """A lone shingle offers every rank once; shares of equal positions are unbiased, with less variance than independent min-hashes have."""
    rng, length = np.random.default_rng(5), 64
    one = superminhash.signatures([np.array([12345], np.uint64)], length)
    assert sorted(np.floor(one[0])) == list(range(length))
    estimates = []
    for _ in range(400):
        u = rng.integers(0, 1 << 63, 60, np.uint64)
        s = superminhash.signatures([u[:50], u[10:]], length)
        estimates.append((s[0] == s[1]).mean())
    true = 40 / 60
    assert abs(np.mean(estimates) - true) < 0.01 and np.var(estimates) < 0.8 * true * (1 - true) / length


def test_stopping_early_changes_no_rank(monkeypatch):
    sets = [np.random.default_rng(i).integers(0, 1 << 63, n, np.uint64) for i, n in enumerate((1, 2, 30, 500, 5000))]
    together = superminhash.signatures(sets, 60)
    alone = np.concatenate([superminhash.signatures([s], 60) for s in sets])
    monkeypatch.setattr(superminhash, "AT_ONCE", 7)
    assert (together == alone).all() and (superminhash.signatures(sets, 60) == together).all()


def test_a_large_group_is_one_component(spark):
    base = " ".join(f"b{i}" for i in range(90))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(base + " x"), F.col("id").cast("string")).alias("text"))
    got = superminhash.near_duplicates(docs).agg(F.count("*"), F.max("component_id"), F.count_if("kept"), F.min("n_shingles")).first()
    assert tuple(got) == (3000, 0, 1, 88)


# 12: spelling variants

LETTERS = [(1, "Straße straße strasse Strase strase"), (2, "colour color colours colour colour colour"), (None, "color  color colur colur colur naïve naïve naïve naive naive naive"), (3, None), (4, ""), (5, "colour " * 30 + "colourx " * 3), (5, "colour " * 30 + "colourx " * 3)]
LETTERS += [(6, "aaaaa " * 3 + "aaaab " * 3 + "aaaac " * 9 + "aaaaaa " * 3 + "baaaa " * 4), (7, "x" * 5000 + " " + "y" * 3000 + " 12 --"), (8, " ".join(f"{'pre' if i % 2 else 'quo'}{chr(97 + i % 26)}{chr(97 + i // 26)}fix" for i in range(500)) * 4)]


def test_variants_match_brute_force(spark):
    want = ordered(spelling.brute_force(LETTERS))
    assert any(r[1] and r[1] != r[2] for r in want) or len(want) > 100
    for most in (spelling.MOST_SHARING, 2, 10**9):
        assert ordered(spelling.group_variants(docs_of(spark, LETTERS), most=most).collect()) == want
    few = ordered(spelling.brute_force(LETTERS, 2, 1, 3, 5))
    assert ordered(spelling.group_variants(docs_of(spark, LETTERS), 2, 1, 3, 5).collect()) == few
    assert spelling.group_variants(docs_of(spark, LETTERS).limit(0)).collect() == []


def test_variants_over_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(QUERIES["op12_spelling_variants"](spark, SF).collect()) == ordered(spelling.brute_force(rows))


def test_common_segments_make_no_pairs_of_all_their_words(spark):
    """5,000 words share their first half; the parts that are compared hold at most a few words each."""
    words = spark.range(5000).select(F.concat(F.lit("prefixes"), F.lpad(F.conv(F.col("id") * 7919 % 456976, 10, 26), 8, "z")).alias("word"))
    rows = [r.word for r in words.collect()]
    near = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) == 1
    want = {(min(a, b), max(a, b)) for i, a in enumerate(rows[:300]) for b in rows[:i] if near(a, b)}
    got = {tuple(r) for r in spelling.near_pairs(words).collect()}
    assert want <= got and all(near(a, b) for a, b in got)


def test_roots_are_the_ends_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)] + [("v", "w40"), ("lone", "other")], "word string, form string")
    assert dict(tuple(r) for r in spelling.follow(forms).collect()) == {f"w{i}": "w40" for i in range(40)} | {"v": "w40", "lone": "other"}


def test_crc_of_packed_words():
    words = pa.array([b"abc", b"", "é".encode() * 9], pa.binary())
    prefix = np.array([zlib.crc32(b"12:"), zlib.crc32(b":"), zlib.crc32(b"7:")], np.uint32)
    assert spelling.crc32s(prefix, words, np.arange(3)).tolist() == [zlib.crc32(b"12:abc"), zlib.crc32(b":"), zlib.crc32(b"7:" + "é".encode() * 9)]


# 13: Merkle manifest

def tampered_text():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def tampered(row):
    doc, text = row[0], row[4]
    return (*row, text if doc is None or text is None or zlib.crc32(str(doc).encode()) % 5 else text.translate(str.maketrans(UPPER, LOWER)))


@pytest.mark.parametrize("how", [{}, {"levels": 1}, {"fanout": 2, "levels": 2}, {"fanout": 3, "levels": 1}])
def test_proofs_match_one_tree(spark, how):
    rows = [(i, "hot" if i > 150 else ("a", "b", None, "é", "")[i % 5], "en" if i % 3 else None, i, f"Text É {i}" if i % 5 else None) for i in range(500)]
    rows += [(None, "a", "x", 1, "t"), (None, None, None, None, None), (3, "a", "en", 1, "Dup"), (3, "a", "en", 1, "Dup"), (9, "lone", "x", 2, ""), (10, "long", "x", 2, "Long " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5).withColumns({c: F.lit("clash") for c in CLASH})
    got = merkle.manifest(docs, tampered_text(), **how).drop("source").collect()
    assert ordered(got) == ordered(merkle.brute_force([tampered(r) for r in rows], how.get("fanout", 16)))
    assert any(not r.verified for r in got)


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = merkle.manifest(spark.createDataFrame([(1, "s", None, 3, "abc")], schema)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == merkle.sha("1:11:s-1:33:abc") and one.proof_sha256 == merkle.sha("")
    assert merkle.manifest(spark.createDataFrame([], schema), tampered_text()).collect() == []


# 8: forms of keys, made by openssl and ssh-keygen where they are at hand


def made_keys(folder):
    """(name, PEM text) of keys of each kind, some of them encrypted."""
    import subprocess

    def run(*args):
        return subprocess.run(args, capture_output=True, check=True, cwd=folder, timeout=120).stdout

    def saved(name, *args):
        run(*args)
        return (folder / name).read_text()

    found = {}
    found["rsa"] = run("openssl", "genpkey", "-algorithm", "RSA", "-pkeyopt", "rsa_keygen_bits:1024").decode()
    (folder / "rsa.pem").write_text(found["rsa"])
    found["rsa traditional"] = run("openssl", "rsa", "-in", "rsa.pem", "-traditional").decode()
    found["rsa encrypted traditional"] = run("openssl", "rsa", "-in", "rsa.pem", "-traditional", "-aes128", "-passout", "pass:secretword").decode()
    found["rsa encrypted"] = run("openssl", "pkcs8", "-topk8", "-in", "rsa.pem", "-passout", "pass:secretword").decode()
    found["ec"] = run("openssl", "genpkey", "-algorithm", "EC", "-pkeyopt", "ec_paramgen_curve:P-256").decode()
    (folder / "ec.pem").write_text(found["ec"])
    found["ec traditional"] = run("openssl", "ec", "-in", "ec.pem").decode()
    found["ed25519"] = run("openssl", "genpkey", "-algorithm", "ED25519").decode()
    run("openssl", "genpkey", "-genparam", "-algorithm", "DSA", "-pkeyopt", "dsa_paramgen_bits:1024", "-out", "dsa.par")
    found["dsa"] = run("openssl", "genpkey", "-paramfile", "dsa.par").decode()
    (folder / "dsa.pem").write_text(found["dsa"])
    found["dsa traditional"] = run("openssl", "dsa", "-in", "dsa.pem", "-traditional").decode() if b"traditional" in subprocess.run(["openssl", "dsa", "-help"], capture_output=True, check=False).stderr else run("openssl", "dsa", "-in", "dsa.pem").decode()
    found["openssh"] = saved("ssh", "ssh-keygen", "-q", "-t", "ed25519", "-N", "", "-f", "ssh")
    return found


def test_every_form_of_every_key_is_found_whole_and_no_damaged_one(tmp_path):
    import base64
    import json
    import re
    import shutil

    from brookwell.llm.secret_scan import KINDS, find_spans

    if not shutil.which("openssl") or not shutil.which("ssh-keygen"):
        pytest.skip("no openssl or ssh-keygen here")
    kind = KINDS.index("private_key")

    def keys_in(text):
        return [(a, b) for a, k, b in find_spans(text) if k == kind]

    for name, pem in made_keys(tmp_path).items():
        pem = pem[pem.index("-----BEGIN") :].strip()
        body = re.search(r"-----BEGIN[^-]*-----(?:(?s:.*?)\n\n)?(.*?)-----END", pem, re.S)[1]
        flat = "".join(body.split())
        forms = {"pem": pem, "crlf": pem.replace("\n", "\r\n"), "escaped": json.dumps(pem)[1:-1], "indented": pem.replace("\n", "\n    "), "base64 of pem": base64.b64encode(pem.encode()).decode()}
        if "encrypted traditional" not in name:
            data = base64.b64decode(flat)
            forms |= {"bare": flat, "lines": body.strip(), "escaped lines": json.dumps(body.strip())[1:-1], "hex": data.hex(), "upper hex": data.hex().upper(), "base64 twice": base64.b64encode(flat.encode()).decode(), "url": base64.urlsafe_b64encode(data).decode()}
        for form, text in forms.items():
            found = keys_in(f"see {text} .")
            assert len(found) == 1 and found[0][0] == 4 and len(text) - 2 <= found[0][1] - 4 <= len(text), (name, form, found, len(text))
        if "encrypted traditional" in name:
            assert not keys_in(pem.replace("DEK-Info", "Other")) and not keys_in(pem.replace(body.strip().split("\n")[-1], "AAAA"))
            continue
        damaged = flat[:8] + "AAAA" + flat[12:] if "openssh" not in name else flat[:24] + "////" + flat[28:]
        for text in (damaged, pem.replace(body.strip(), damaged), base64.b64encode(damaged.encode()).decode(), base64.b64decode(damaged).hex()):
            assert not keys_in(f"see {text} ."), name


def test_signed_tokens_with_white_space_in_their_heads():
    import base64

    from brookwell.llm.secret_scan import KINDS, find_spans

    code = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    for head in ('{"alg":"HS256"}', '{ "alg": "HS256"}', '{\n "alg": "HS256"}', '{\r\n"alg":"x"}', '{\t"alg":"x"}', ' {"alg":"HS256"}', '\n{"alg":"HS256"}', '\t{"alg":"HS256"}', '\r\n{"alg":"HS256"}'):
        token = f"{code(head)}.{code('{"sub": 1}')}.sig"
        assert [(a, k, b) for a, k, b in find_spans(f"t {token}")] == [(2, KINDS.index("signed_token"), 2 + len(token))], head
    assert find_spans(f"t {code('{"no":1}')}.{code('{}')}.sig") == [] and find_spans("ewogood.names.in eyes.and.ears") == []
