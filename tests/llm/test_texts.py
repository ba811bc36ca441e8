"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from quarry.llm import jaccard_join, language_id, mixing, packing, pii, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, percent=75):
    """By row place: number of shingles and smallest id reachable."""
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return [(r[0], len(s), least.get(top(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("crowd", [24, 0])
def test_jaccard_components(rows, docs, monkeypatch, crowd):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "SIDE", 16)
    got = [tuple(r) for r in jaccard_join.jaccard_components(docs).collect()]
    assert sorted(got, key=key) == sorted(components(rows), key=key)


def test_crowded_nodes_are_listed_anew_by_what_is_frequent(spark, monkeypatch):
    """Texts that merely share passages which the first ordering takes for rare: listed by the counts of the crowded lists they don't meet, and all links are found."""
    monkeypatch.setattr(jaccard_join, "LOCAL_DF", 1 << 30)
    monkeypatch.setattr(jaccard_join, "CROWD", 2)
    monkeypatch.setattr(jaccard_join, "RELISTED", 0, raising=False)
    draw = random.Random(7)
    texts = []
    for i in range(120):
        base = [f"w{i}x{j}" for j in range(70)]
        at = draw.randrange(70)
        base[at:at] = [f"p{i % 3}y{j}" for j in range(12)]
        texts.append(" ".join(base))
        if i % 5 == 0:
            texts += [" ".join(w if j != 3 * n else "other" for j, w in enumerate(base)) for n in range(3)]
    table = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    crowds, cut = [], jaccard_join.cut

    def seen(frame, name):
        out = cut(frame, name)
        if name == "crowd":
            crowds.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "cut", seen)
    got = [tuple(r) for r in jaccard_join.jaccard_components(df).collect()]
    assert sorted(got, key=key) == sorted(components(table), key=key)
    assert crowds[0] > 100 and crowds[-1] == 0


def test_crowded_lists_meet_by_size_in_bounded_rounds(spark, monkeypatch):
    """Near copies in several sizes around passages that all texts have: the same links in many rounds, and no block meets one of far other sizes."""
    monkeypatch.setattr(jaccard_join, "CROWD", 0)
    monkeypatch.setattr(jaccard_join, "SIDE", 16)
    monkeypatch.setattr(jaccard_join, "SHIPPED", 1 << 16)
    draw = random.Random(5)
    common = [f"c{i}" for i in range(9)]
    texts = []
    for i in range(60):
        base = [f"w{i}x{j}" for j in range(8 * 2 ** (i % 4))] + common
        for _ in range(4):
            texts.append(" ".join(w if draw.random() > 0.02 else "other" for w in base))
    table = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    written, cut = [], jaccard_join.cut

    def seen(frame, name):
        out = cut(frame, name)
        written.append((name, out))
        return out

    monkeypatch.setattr(jaccard_join, "cut", seen)
    got = [tuple(r) for r in jaccard_join.jaccard_components(df).collect()]
    assert sorted(got, key=key) == sorted(components(table), key=key)
    meet = [frame.collect() for name, frame in written if name == "meetings"]
    assert meet and sum(name == "verified" for name, _ in written) > 3
    blocks = {b for m in meet[-1] for b in (m.a, m.b)}
    assert len(meet[-1]) < len(blocks) * (len(blocks) + 1) / 4


def test_empty_tables(spark, none):
    assert jaccard_join.jaccard_components(none).count() == 0
    assert packing.pack(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert pii.find_pii(none).count() == 0 and secrets.find_secrets(none).count() == 0
    assert language_id.identify(none, language_id.learn(language_id.labelled_part(none))).count() == 0
    assert quality.judge(none, quality.log_ratios(none, none)).count() == 0


def test_packing_is_gapless_and_exact(rows, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(docs).toPandas()
    by_doc = collections.defaultdict(list)
    for p in got.itertuples():
        by_doc[None if p.doc_id != p.doc_id else int(p.doc_id)].append((p.piece, p.start, p.length, p.ids_crc32))
    for doc_id, text in {r[0]: r[1] for r in rows}.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert sorted(set(by_doc[doc_id])) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_words_tokenize_like_whole_texts():
    words = packing.word_ids(None)
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice("aBzÉßñçİIſKΣσΑ'st.,!?-12½\u2003 \t\u0301\u0307中ह<|endoftext|>é") for _ in range(r.randint(0, 30)))
        assert np.frombuffer(words.ids(text), "<u4").tolist() == words.whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("shard, region", [(1 << 18, 1024), (200, 4)])
def test_mix_equals_its_sql(spark, docs, tmp_path, monkeypatch, shard, region):
    monkeypatch.setattr(mixing, "SHARD", shard)
    monkeypatch.setattr(mixing, "REGION", region)
    monkeypatch.setattr(mixing, "ORACLE", mixing.ORACLE.replace("262144::DOUBLE", f"{shard}::DOUBLE").replace("shards / 1024::DOUBLE", f"shards / {region}::DOUBLE"))
    docs.write.parquet(str(tmp_path / "documents"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    got = [tuple(r)[:5] for r in mixing.mix(docs).collect()]
    want = c.execute(mixing.ORACLE).fetchall()
    assert sorted(got, key=key) == sorted(want, key=key)
    assert all(t <= 3 * s for _, s, _, _, t in got)
    by = {(g[2], g[3]): 0 for g in got}
    for g in got:
        by[g[2], g[3]] += g[4]
    if shard > 1000:  # shards of a few blocks can't take parts of blocks
        assert all(abs(taken - target) <= max(2 * mixing.BLOCK, 0.02 * target) for (_, target), taken in by.items())


def test_repeated_rows_fill_no_shard_of_their_own(spark, monkeypatch):
    """15,000 equal rows and few others: the largest shard is little above the mean."""
    monkeypatch.setattr(mixing, "SHARD", 2_000)
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rows = [(1, "one two three four five six", "a")] * 15_000 + [(i, f"text {i} of some words", "a") for i in range(2, 3_000)] + [(5, None, "b")] * 40 + [(7, "x y", "b")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sizes = []
    seats = mixing._seats

    def watched(parties, votes, *rest):
        if "shard" in parties.columns:
            sizes.extend((r.source, r.shard_size) for r in parties.select("source", "shard_size").collect())
        return seats(parties, votes, *rest)

    monkeypatch.setattr(mixing, "_seats", watched)
    got = mixing.mix(docs).collect()
    a = [n for s, n in sizes if s == "a"]
    assert len(a) == 53 and max(a) < 1.4 * sum(a) / len(a) and sum(a) == 15_000 * 6 + 2_998 * 5
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((i, len((t or "").split())) for i, t, _ in rows)
    assert all(r.taken <= 3 * r.size for r in got)
    for s in {(r.source_size, r.target) for r in got}:
        assert abs(sum(r.taken for r in got if (r.source_size, r.target) == s) - s[1]) <= 0.01 * s[1] + 16


def test_cut_documents_keep_their_lines(spark):
    text = "\n".join(f" word{i}\t x{i}  y" for i in range(400)) + "\n"
    docs = spark.createDataFrame([(i, text, s) for i, s in enumerate("aab")] + [(9, None, "c"), (9, None, "c")], "doc_id long, text string, source string")
    got = [r.text for r in mixing.materialize(docs).collect()]
    assert got and all(text.startswith(t) for t in got) and any(len(t) < len(text) for t in got)


def test_mixed_documents_hold_the_words_taken(docs):
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    assert sum(len(WORD.findall(r.text or "")) for r in mixing.materialize(docs).collect()) == taken


def test_language_of_held_out_texts(spark):
    r = random.Random(2)
    sounds = {"x": ("an", "re", "th", "on"), "y": ("ou", "ez", "la", "que"), "z": ("sch", "ich", "ung", "der")}
    rows = [(i, " ".join("".join(r.choice(sounds[l]) for _ in range(3)) for _ in range(20)), l) for i in range(300) for l in [r.choice("xyz")]]
    rows += [(1000, None, "x"), (1001, "12 34", "y"), (1002, "", None), (None, "anreth on", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {g.doc_id: g for g in language_id.identify(docs, language_id.learn(language_id.labelled_part(docs))).collect()}
    for i, text, lang in rows[:300]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert got[1000].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und" and not got[None].held_out


def test_counting_many_languages_passes_counts_on(spark, monkeypatch):
    import pyarrow as pa

    rows = [(f"l{i % 40}", "abc abd " * (1 + i % 3)) for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    got = collections.Counter()
    for b in language_id._count(iter([batch, batch])):
        for lang, slot, n in zip(*(c.to_pylist() for c in b.columns)):
            got[lang, slot] += n
    want = collections.Counter()
    for lang, text in rows * 2:
        for _, slots in language_id._blocks([text]):
            want.update((lang, s) for s in slots.tolist())
    assert got == want


def test_languages_of_edge_rows(spark):
    """Ties, repeated rows, letters no language has, a very long text, clashing columns."""
    rows = [(i, t, l, 1, "x") for i, (t, l) in enumerate([("abab abab", "p"), ("cdcd cdcd", "q")] * 6)]
    rows += [(100, "中文字", None, 1, "x"), (100, "中文字", None, 1, "x"), (101, "abab " * 200_000, None, 1, "x"), (102, "abab cdcd", None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long, lang_pred string")
    got = collections.defaultdict(set)
    for r in language_id.identify(docs, language_id.learn(language_id.labelled_part(docs))).collect():
        got[r.doc_id].add((r.lang_pred, round(r.score, 3)))
    assert got[101] == {("p", 1.0)} and len(got[100]) == 1 and got[100] <= {("p", 0.0), ("q", 0.0)} and got[102] == {("p", 0.5)}


def test_filter_hits_and_correction_equal_plain_sets():
    """Hits of the bit-sliced filters hold all true ones; corrected counts come near the true ones."""
    r = np.random.default_rng(1)
    sets = {f"l{k}": np.unique(r.integers(0, 1 << 20, 3000)) for k in range(11)}
    f = language_id.Filters(sets)
    slots = r.integers(0, 1 << 20, 40_000)
    slots[:20_000] = r.choice(sets["l7"], 20_000)
    hits = f.hits(np.zeros(len(slots), np.int64), slots, 1)[0]
    for k, lang in enumerate(f.langs):
        true = np.isin(slots, sets[lang]).sum()
        plain = np.logical_and.reduce([(f.slices[k // 8][p] >> (k % 8) & 1).astype(bool) for p in f.positions(slots)]).sum()
        corrected = (hits[k] - f.false[k] * len(slots)) / (1 - f.false[k])
        assert hits[k] == plain >= true and abs(corrected - true) <= 0.02 * len(slots)


def test_language_blocks_do_not_change_counts(monkeypatch):
    texts = ["abc def" * 40, "x", None, "ghi " * 9]
    count = lambda: collections.Counter((t, s) for a, b in language_id._blocks(texts) for t, s in zip(a.tolist(), b.tolist()))
    whole = count()
    monkeypatch.setattr(language_id, "_BLOCK", 7)
    assert count() == whole


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    out = []
    for k, name in enumerate(pii.KINDS):
        for m in re.finditer(PII[name], text):
            d = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(p) > 255 for p in m[0].split(".")) or name == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or name == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_pii_equals_plain_patterns():
    r = random.Random(1)
    for _ in range(20000):
        text = "".join(r.choice(["a", "@", "b.c", ".", "1", "2", "25", "300", " ", "-", "+", "(", ")", "4111111111111111", "\n", "é"]) for _ in range(r.randint(0, 25)))
        assert plain_pii(text) == pii.base_spans(text), text


def test_the_field_finds_what_it_learned_and_leaves_other_numbers():
    field = pii.field()
    lines = pii.training_lines(99, 300)
    right = sum(field.decode(text) == gold for text, gold in lines)
    assert right >= 0.94 * len(lines)
    assert pii.all_spans("call (017) 555-7713 now", field)[1] == [(3, 5, 19)]
    for clean in ("order 0171 5557713", "on 2024-01-02 at 12:30", "version 3.0.1.", "id 7536784127813050 4845168114407329"):
        assert pii.all_spans(clean, field)[1] == []


def test_spelled_addresses_need_no_digit_nearby():
    found = lambda t: [t[a:b] for k, a, b in pii.all_spans(t, pii.field())[1] if k == 0]
    long = "first.middle.last_name-of-department(at)mail.some-long-host.example.com"
    for text, want in (
        ("write to jane.doe [at] example.com", ["jane.doe [at] example.com"]), ("jane.doe(at)example.com", ["jane.doe(at)example.com"]),
        ("In room 12: jane.doe [AT] example.com.", ["jane.doe [AT] example.com"]), ("word " * 60 + f"to {long}, " + "word " * 60, [long]),
        ("jane.doe [at] example.com and joe_b(at)example.org.", ["jane.doe [at] example.com", "joe_b(at)example.org"]),
    ):
        assert found(text) == want
        assert all(w not in pii.mask(text, pii.all_spans(text, pii.field())[1]) for w in want)
    for clean in ("the price (at) closing", "a [at] b", "jane.doe\n\n(at)\n\nexample.com", "(at)example.com"):
        assert found(clean) == []


def test_decoding_equals_trying_all_segmentations():
    field = pii.field()
    r = random.Random(9)
    for _ in range(150):
        text = "".join(r.choice(["call ", "1", "22", "333", "4444", ".", "-", " ", "@", "ab", "+", "(at)"]) for _ in range(r.randint(1, 7)))
        borders, segments = pii._segments(text)
        n = len(borders) - 1
        steps = {}
        for i, j, y, features in segments:
            steps.setdefault(i, []).append((j, y, field.score(features)))

        def best(i, last):
            if i == n:
                return 0.0
            return max(s + field.trans[last, y] + best(j, y) for j, y, s in [(i + 1, 0, 0.0), *steps.get(i, ())])

        at = {b: k for k, b in enumerate(borders)}
        chosen, total, last, i = {at[a]: (at[b], kind + 1) for kind, a, b in field.decode(text)}, 0.0, 0, 0
        while i < n:
            j, y = chosen.get(i, (i + 1, 0))
            total += field.trans[last, y] + (max(s for jj, yy, s in steps[i] if (jj, yy) == (j, y)) if y else 0.0)
            i, last = j, y
        assert abs(total - best(0, 0)) < 1e-9, text


def test_spans_of_many_entities_are_found_fast():
    import time

    text = "".join(f"a{i}@b.org " for i in range(30_000)) + "jane [at] example.com "
    began = time.perf_counter()
    base, every = pii.all_spans(text[:400_000], pii.Field())
    assert len(base) > 25_000 and time.perf_counter() - began < 60


def test_field_gradient_is_exact():
    f = pii.Field()
    lines = pii.training_lines(3, 6)
    f.fit(lines, rounds=2)
    data = []
    for text, gold in lines:
        borders, segments = pii._segments(text)
        at = {b: k for k, b in enumerate(borders)}
        data.append((len(borders) - 1, [(i, j, y, np.array([f.names[x] for x in fs])) for i, j, y, fs in segments], {(at[a], at[b], k + 1) for k, a, b in gold}))

    def log_likelihood(w):
        total = 0.0
        for n, rows, want in data:
            alpha = np.full((n + 1, 5), -np.inf)
            alpha[0, 0] = 0
            gold, at, last = 0.0, 0, 0
            starts = {i: (j, y, s) for i, j, y, x in rows if (i, j, y) in want for s in [w[x].sum()]}
            for j in range(1, n + 1):
                for i, _, y, x in [(j - 1, j, 0, None)] + [r for r in rows if r[1] == j]:
                    alpha[j, y] = np.logaddexp(alpha[j, y], (0 if x is None else w[x].sum()) + np.logaddexp.reduce(alpha[i] + f.trans[:, y]))
            while at < n:
                j, y, s = starts.get(at, (at + 1, 0, 0.0))
                gold += s + f.trans[last, y]
                at, last = j, y
            total += gold - np.logaddexp.reduce(alpha[n])
        return total

    grad, t = np.zeros(len(f.w)), np.zeros_like(f.trans)
    for n, rows, want in data:
        f._gradient(n, rows, want, grad, t)
    for k in range(0, len(f.w), 7):
        step = np.zeros(len(f.w))
        step[k] = 1e-5
        assert abs((log_likelihood(f.w + step) - log_likelihood(f.w - step)) / 2e-5 - grad[k]) < 1e-5


def test_pii_rows_and_masking(rows, docs):
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for doc_id, text, *_ in rows:
        base = plain_pii(text or "")
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert got[doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[doc_id].n_card == sum(k == 2 for k, _, _ in base)
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for doc_id, text, *_ in rows:
        assert plain_pii(masked[doc_id] or "") == [] and (got[doc_id].spans or masked[doc_id] == text)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_base_secrets_equal_plain_patterns(rows, docs):
    r = random.Random(1)
    for _ in range(10000):
        text = "".join(r.choice(["token", "API_KEY", "secret", "=", ":", " ", '"', "AKIA", "ABCDEFGHIJ12345", "0123456789abcdef", "a", "é", "\n", "ABCDEF", "_x", "."]) for _ in range(r.randint(0, 14)))
        assert plain_secrets(text) == secrets.base_spans(text), text
    got = {x.doc_id: x for x in secrets.find_secrets(docs).collect()}
    assert all(got[i].n_assign == sum(k == 0 for _, k, _ in plain_secrets(t or "")) for i, t, *_ in rows)


def test_the_lexer_follows_names():
    found = lambda t: [t[a:b] for a, k, b in secrets.all_spans(t)[1] if k == 3]
    assert found('db_password = "hunter2!X9z"') == ["hunter2!X9z"]
    assert found('BASE = "s3cr3tV@lue99"\nOTHER = BASE\napi_secret = OTHER\n') == ["s3cr3tV@lue99"]
    assert found('{"private_key": "abc" + "DEF123xyz!!9"}') == ['abc" + "DEF123xyz!!9']
    for clean in ("password: changeme", 'name: "John Smith"', "The secret: be kind to all", "public_key_path = /etc/keys/a1B2c3D4.pem"):
        assert found(clean) == []


def test_the_lexer_finds_bare_literals():
    found = lambda t: [t[a:b] for a, k, b in secrets.all_spans(t)[1] if k == 3]
    assert found("HOST=db1\nDB_PWD=Qx7kP2mZr9tLw4Bn\n") == ["Qx7kP2mZr9tLw4Bn"]
    assert found("db:\n  passphrase: hR83kd02mmQz\n") == ["hR83kd02mmQz"]
    assert found("aws.access_key = Zk39dkfj3kd9sQ1x") == ["Zk39dkfj3kd9sQ1x"]
    assert found('part_2b = "s3cr3tV@lue99"\ndb_pwd = part_2b') == ["s3cr3tV@lue99"]
    for clean in ("part_2b = read()\ndb_pwd = part_2b", "db_pwd = decrypt_aes256(x)", "db_pwd = settings.database"):
        assert found(clean) == []


def test_the_lexer_reads_values_of_any_length():
    found = lambda t: [t[a:b] for a, k, b in secrets.all_spans(t)[1] if k == 3]
    r = random.Random(6)
    body = "".join(r.choice("ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(1600)) + "7="
    pem = r"-----BEGIN PRIVATE KEY-----\n" + body + r"\n-----END PRIVATE KEY-----\n"
    assert found('{"type": "service_account", "private_key": "' + pem + '", "id": 3}') == [pem]
    assert found(f"export SIGNING_KEY={body}\nPORT=80") == [body] and found(f"db_pwd = '{body}' + '{body}'") == [f"{body}' + '{body}"]
    assert found(r'db_pwd = "hunt\"er2\\!X9z"') == [r"hunt\"er2\\!X9z"] and found(r"db_pwd = 'D:\hunter2!X9\'") == [r"D:\hunter2!X9\\"[:-1]]
    assert found("pass=" * 40000) == [] and found('db_pwd = "' + body) == []


def test_quality_counts(rows, docs):
    got = {r.doc_id: r for r in quality.judge(docs, [0.0] * quality.BUCKETS).collect()}
    for doc_id, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and r.kept == (not r.base_failed)


def test_quality_ratio_prefers_trusted_words(spark):
    good, bad = "the clean words of a good text in order again", "!!BUY!! %%% NOW|| $$$ <<x>> ||| !!BUY!! && ## *"
    docs = spark.createDataFrame([(i, good if i < 2000 else bad) for i in range(4000)], "doc_id long, text string")
    rows = quality.judge(docs, quality.log_ratios(docs, docs.where("doc_id < 1000"))).collect()
    assert all((r.score > 0) == (r.doc_id < 2000) for r in rows) and not any(r.kept for r in rows if r.doc_id >= 2000)


def test_names_hold_what_was_assigned_last(spark):
    found = lambda t: [t[a:b] for a, k, b in secrets.all_spans(t)[1] if k == 3]
    assert found('X = "s3cr3tV@lue99"\napi_pwd = X\nX = "0th3rV@lue11"\n') == ["s3cr3tV@lue99"]
    assert found("api_pwd = X\nX = 's3cr3tV@lue99'\n") == ["s3cr3tV@lue99"] and found("a_pwd = b_pwd\nb_pwd = a_pwd\n") == []
    assert found("n" * 65 + '_pwd = "s3cr3tV@lue99"') == found("db_pwd" + " " * 9 + '="s3cr3tV@lue99"') == found('db_pwd: Str = "s3cr3tV@lue99"') == ["s3cr3tV@lue99"]


def test_propagation_equals_brute_force():
    r = random.Random(8)
    for _ in range(3000):
        names = ["a", "b", "c_pwd", "d_secret", "name"]
        lines = [(r.choice(names), r.choice([*names, '"Zq8!kP2xWm"'])) for _ in range(r.randint(1, 8))]
        text = "".join(f"{n} = {v}\n" for n, v in lines)
        want = [None if v[0] != '"' else 0 for _, v in lines]
        for i, (name, _) in enumerate(lines):
            at, steps = i, 0
            while at is not None and lines[at][1][0] != '"' and steps <= len(lines):
                word, steps = lines[at][1], steps + 1
                at = max((j for j in range(at) if lines[j][0] == word), default=min((j for j in range(at, len(lines)) if lines[j][0] == word), default=None))
            if at is not None and lines[at][1][0] == '"':
                want[at] = max(want[at], secrets.name_score(name))
        assert secrets.sensitivity(text, list(secrets.pairs_of(text))) == want, text


def test_scans_of_many_literals_are_linear():
    import time

    def seconds(n):
        text = "".join(f'db_pwd{i} = "s3cr3tV@lue{i}"\n' for i in range(n)) + "".join(f"v{i + 1} = v{i}\n" for i in range(n)) + 'v0 = "s3cr3tV@lue99"\n' + f"my_pwd = v{n}\n"
        began = time.perf_counter()
        assert len(secrets.all_spans(text)[1]) == n + 1
        return time.perf_counter() - began

    assert seconds(32_000) < 10 * max(seconds(8_000), 0.05)


def test_quality_scores_equal_plain_counts(spark, rows, docs):
    """Log ratios and scores from words and pairs hashed as Spark hashes them, counted in Python."""
    import math
    import struct

    import xxhash

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def hashed(value, seed=42):
        return signed(xxhash.xxh64(value.encode() if isinstance(value, str) else struct.pack("<q", value), seed=seed % (1 << 64)).intdigest())

    def buckets(text):
        w = [hashed(x) for x in WORD.findall(text or "")]
        return [h % quality.BUCKETS for h in w + [hashed(b, hashed(a)) for a, b in zip(w, w[1:])]]

    trusted = {r[0] for r in rows[:40]}
    every, good = collections.Counter(), collections.Counter()
    for r in rows:
        found = buckets(r[1])
        every.update(found)
        if r[0] in trusted:
            good.update(found)
    e, g = every.total() + quality.BUCKETS, good.total() + quality.BUCKETS
    want = [math.log((good[b] + 1) / g) - math.log((every[b] + 1) / e) for b in range(quality.BUCKETS)]
    ratios = quality.log_ratios(docs, docs.where("doc_id < 40").select("doc_id"))
    assert np.allclose(ratios, want)
    text = {r[0]: r[1] for r in rows}
    for r in quality.judge(docs, ratios).collect():
        found = buckets(text[r.doc_id])
        score = sum(want[b] for b in found) / len(found) if found else 0.0
        assert abs(r.score - score) < 1e-6 and r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_placement_equals_trying_every_open_sequence():
    """Every piece, longest first, goes where the sum of squared counts of open sequences by gap becomes smallest."""
    r = np.random.default_rng(2)
    for _ in range(30):
        lengths = r.integers(1, 21, int(r.integers(1, 60)))
        seq, off = packing.place(lengths, 20)
        fill = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            def squares(k):
                gaps = collections.Counter(20 - (f + lengths[i] * (j == k)) for j, f in enumerate(fill))
                del gaps[0]
                return sum(n * n for n in gaps.values()), 20 - fill[k]

            fits = [k for k, f in enumerate(fill) if f + lengths[i] <= 20]
            if fits:
                best = min(map(squares, fits))
                assert off[i] > 0 and squares(seq[i]) == best and fill[seq[i]] == off[i]
            else:
                assert off[i] == 0 and seq[i] == len(fill)
                fill.append(0)
            fill[seq[i]] += lengths[i]


def test_ordered_shingles_are_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ORDERED", 100)
    often = spark.createDataFrame([(i, 1000) for i in range(40)] + [(1000 + i, 10) for i in range(5000)], "gram long, df long")
    grams, df = jaccard_join._ordered(often)
    assert set(range(40)) <= set(grams.tolist()) and 40 < len(grams) < 200
    grams, _ = jaccard_join._ordered(often.where("df = 10"))
    assert 0 < len(grams) < 250 and jaccard_join._ordered(often.limit(0))[0].size == 0


def test_sketches_allow_every_pair_that_links():
    r = np.random.default_rng(7)
    refused = 0
    for _ in range(2000):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([r.choice(a, int(r.integers(0, len(a) + 1)), replace=False), r.integers(0, 1 << 63, int(r.integers(0, n + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        allowed = jaccard_join.may_link(jaccard_join._sketch(a), jaccard_join._sketch(b), 75)
        assert allowed or 100 * both < 75 * (len(a) + len(b) - both)
        refused += not allowed
    assert refused > 800 and jaccard_join.may_link(jaccard_join._sketch(np.zeros(300, np.uint64)), b"", 75)


PASS = "Qx7kP2mZr9tLw4BnYc8d"
FORMS = [
    f'db_pwd = b"{PASS}"', f"db_pwd = r'{PASS}'", f'db_pwd = f"{PASS}"', f'db_pwd = """{PASS}"""', f'db_pwd = """\n{PASS}\n"""', f"db_pwd = '''{PASS}'''", f'db_pwd = ("{PASS}")',
    f'db_pwd = ("{PASS[:9]}"\n    "{PASS[9:]}")', f'db_pwd = "{PASS[:9]}" "{PASS[9:]}"', f"$db_pwd = '{PASS[:9]}' . '{PASS[9:]}';", f'db_pwd: |\n  {PASS}\nother: 1', f"db_pwd: >-\n  {PASS[:9]}\n\n  {PASS[9:]}\n",
    f"db_pwd:\n  {PASS}\nx: 1", f'"db_pwd":\n  "{PASS}"', f'db_pwd = \\\n  "{PASS}"', f'const dbPwd string = "{PASS}"', f'var dbPwd []byte = "{PASS}"', f'user, db_pwd = "bob", "{PASS}"', f'db_pwd = os.getenv("X", "{PASS}")',
    f'connect(os.getenv("DB_PWD", "{PASS}"))', f'db_pwd = env.get("DB_PWD") or "{PASS}"', f'db_pwd = process.env.X || "{PASS}"', f"db_pwd = x ?? '{PASS}'", f"DB_PWD=p@ss!{PASS}", f"export DB_PWD={PASS}#(1", f"  - db_pwd: {PASS}",
    f'{{"a":true,"db_pwd":"{PASS}"}}', f"<a db_pwd={PASS}>", f"private_key: |\n  -----BEGIN KEY-----\n  {PASS}{PASS}\n  {PASS}==\nb: 2",
]


@pytest.mark.parametrize("text", FORMS)
def test_literals_are_found_in_every_form(text):
    found = [text[a:b] for a, b in secrets.lexed(text)]
    bare = re.sub(r"[\s'\".]+", "", "".join(found)).replace("-----BEGINKEY-----", "")
    assert len(found) == 1 and bare.replace(PASS, "") in ("", "p@ss!", "#(1", "==") and PASS in bare
    assert not secrets.lexed(text.replace("db_pwd", "length").replace("DB_PWD", "LENGTH").replace("dbPwd", "length").replace("private_key", "length"))


def test_every_value_has_its_own_name():
    text = f'length, db_pwd, size = "{PASS}", "other9Kd82mZq1w", "{PASS}"'
    assert [text[a:b] for a, b in secrets.lexed(text)] == ["other9Kd82mZq1w"]
    text = f'a: |\n  b: |\n    {PASS}\n  db_pwd: |\n    {PASS}\n  c: 1'
    assert secrets.lexed(text) == [(text.rindex(PASS), text.rindex(PASS) + len(PASS))]


def test_lexing_takes_linear_time():
    import time

    for piece in ('a="""', "a=(", "a: |\n ", "a:\n", "a = b, ", "a,", 'f("a",', "a=", "x='", "a = f(\n", 'a = "x" ', "a = x or ", "a: \n b: \n", 'x("a", "b", ', "a.b = c + ", "- ", "export "):
        spent = []
        for n in (20_000, 80_000):
            text = piece * n + "=1"
            began = time.process_time()
            secrets.lexed(text)
            spent.append(time.process_time() - began)
        assert spent[1] < 10 * max(spent[0], 0.05), piece
