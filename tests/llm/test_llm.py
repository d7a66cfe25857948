import random
import re
import textwrap
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riacho.llm import abuse, boilerplate, budget, encode, garble, leak, lexicon, pieces, scans
from riacho.llm.suffix import common_prefixes, suffix_array

RANKS = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken"
ODD = ["", " ", "  a", "a  ", "don't we'll I'VE 's's'sabc", "\n\n x\t\ty", "<|endoftext|>", "x" * 3000, "1" * 2000, " " * 2000 + "z", "²½ _é_ __ \x1c\x1d", "🎉 漢字 ab", "é" * 100]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'stlrve \n\té1²_.🎉\x1c"), max_size=25))
def test_pieces_match_the_pattern(text):
    cp, _ = pieces.code_points([text])
    start, length = pieces.split_points(cp)
    assert [cp[s : s + n].tobytes().decode("utf-32-le") for s, n in zip(start, length, strict=True)] == pieces.split_text(text)
    assert [p for c in pieces.chunks(text) for p in pieces.split_text(c)] == pieces.split_text(text)


def test_transducer_numbers_words_and_shares_suffixes(tmp_path):
    rng = random.Random(1)
    words = {"".join(rng.choices("abcé", k=rng.randint(1, 6))): [i, i + 1] for i in range(500)}
    arrays = lexicon.compile_lexicon(words)
    (tmp_path / "l").write_bytes(lexicon.to_bytes(arrays))
    lex = lexicon.map_file(str(tmp_path / "l"))
    asked = [*words, "zzz", "abcéabcé", "ab香"]
    cp, begins = pieces.code_points(asked)
    numbers = lexicon.look_up(lex, cp, begins[:-1], np.array([len(w) for w in asked]))
    for w, n in zip(asked, numbers.tolist(), strict=True):
        if w in words:
            assert lex["ids"][lex["offsets"][n] : lex["offsets"][n + 1]].tolist() == words[w]
        else:
            assert n == -1
    states = len(lex["base"])
    assert states < sum(map(len, words)) / 2
    empty = lexicon.compile_lexicon({})
    assert lexicon.look_up(empty, cp, begins[:-1], np.array([len(w) for w in asked])).tolist() == [-1] * len(asked)


def test_encoding_is_exact(spark):
    exact = encode.load_ranks(RANKS)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(98, None, "x"), (None, "a", "x"), (0, ODD[0], "x")], "doc_id long, text string, ids string")
    rows = encode.encode(df, words=20).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        text = "a" if r.doc_id is None else None if r.doc_id == 98 else ODD[r.doc_id]
        assert r.ids == exact.encode_ordinary(text or "")
    assert encode.encode(df.limit(0)).count() == 0


def test_budget_equals_direct_counts(spark):
    exact = encode.load_ranks(RANKS)
    rng = random.Random(2)
    rows = [(i, rng.choice(ODD + [None, "um texto comum"] * 5), rng.choice(["a", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: (r.n_docs, r.n_empty, r.n_null, r.n_tokens) for r in budget.token_totals(df, "text", ["source"]).collect()}
    for s in ("a", None):
        mine = [t for _, t, x in rows if x == s]
        assert got[s] == (len(mine), mine.count(""), mine.count(None), sum(len(exact.encode_ordinary(t or "")) for t in mine))
    docs = {r.doc_id: r.n_tokens for r in budget.document_tokens(df).collect()}
    assert docs == {i: len(exact.encode_ordinary(t or "")) for i, t, _ in rows}
    assert budget.token_totals(df.limit(0), "text", ["source"]).count() == 0


def test_large_lengths_are_joined_in_salts(spark, monkeypatch):
    monkeypatch.setattr(budget, "checked_broadcast", lambda df: (df, False))
    df = spark.createDataFrame([(i, "um dois um", "s") for i in range(50)], "doc_id long, text string, source string")
    exact = encode.load_ranks(RANKS)
    assert budget.token_totals(df, "text", ["source"]).first().n_tokens == 50 * len(exact.encode_ordinary("um dois um"))


def norm_line(x):
    return " ".join(x.split()).lower()


def brute_lines(rows, share=0.05, least=5):
    total, seen = Counter(), defaultdict(set)
    for n, (_, s, t) in enumerate(rows):
        total[s] += 1
        for x in (t or "").split("\n") if t is not None else []:
            if sum(map(str.isalpha, norm_line(x))) >= 12:
                seen[s, norm_line(x)].add(n)
    often = {k for k, v in seen.items() if len(v) >= least and len(v) * 1000 >= total[k[0]] * share * 1000}
    return {(d, i) for d, s, t in rows if t is not None for i, x in enumerate(t.split("\n"), 1) if (s, norm_line(x)) in often}


@pytest.mark.parametrize("small", [True, False])
def test_repeated_lines_against_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(boilerplate, "checked_broadcast", lambda df: (df, False))
    rng = random.Random(7)
    stock = ["Aviso legal desta página", "AVISO  legal\tdesta página ", "Compartilhe esta notícia", "curta", "Todos os direitos reservados", "1234567890123"]
    rows = []
    for i in range(160):
        own = [f"linha própria do documento {i} {k}" for k in range(rng.randint(0, 3))]
        mix = own + rng.choices(stock, k=rng.randint(0, 4))
        rng.shuffle(mix)
        rows.append((i, rng.choice(["a", "b", None]), "\n".join(mix)))
    rows += [(500, "a", None), (501, "a", ""), (502, "c", "\n".join(stock)), (503, "b", "x" * 50_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, text string, line_no string")
    b = boilerplate.Boilerplate(df)
    got = [tuple(r) for r in b.lines().collect()]
    want = brute_lines(rows)
    assert set(got) == want and len(got) == len(want)
    cleaned = {r.doc_id: r.text for r in b.cleaned().collect()}
    for d, _, t in rows:
        assert cleaned[d] == (t if t is None else "\n".join(x for i, x in enumerate(t.split("\n"), 1) if (d, i) not in want))
    assert boilerplate.Boilerplate(df.limit(0)).lines().count() == 0


def test_multi_line_blocks_are_found(spark):
    rows = [(i, "a", f"texto próprio número {i}\nprimeira linha do bloco\nsegunda linha do bloco\nterceira linha do bloco") for i in range(30)]
    b = boilerplate.Boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    sizes = {(r.n, r.n_docs) for r in b.blocks.select(F.size("block").alias("n"), "n_docs").collect()}
    assert (3, 30) in sizes
    assert {(r.from_line, r.n_lines) for r in b.spans().collect()} == {(2, 3), (3, 2), (4, 1)}


@pytest.mark.parametrize("shard", [3, 20_000])
def test_blocks_of_any_length(spark, monkeypatch, shard):
    """A notice of seventy lines comes out whole, counted over all shards."""
    monkeypatch.setattr(boilerplate, "SHARD_SEQUENCES", shard)
    notice = "\n".join(f"cláusula geral do aviso {'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(70))
    rows = [(i, "a", f"texto próprio {i}\n{notice}" + ("\ncláusula geral do aviso aa" * (i % 4))) for i in range(24)]
    b = boilerplate.Boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    sizes = {(r.n, r.n_docs) for r in b.blocks.select(F.size("block").alias("n"), "n_docs").collect()}
    assert (70, 24) in sizes and (71, 18) in sizes and (73, 6) in sizes and max(sizes)[0] == 73


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30))
def test_suffix_array_and_prefixes(symbols):
    s = np.array([*symbols, 0])
    order = suffix_array(s)

    def key(i):
        out = []
        for j in range(i, len(s)):
            out.append((0, j) if s[j] == 0 else (1, int(s[j])))
            if s[j] == 0:
                break
        return out

    assert order.tolist() == sorted(range(len(s)), key=key)
    shared = common_prefixes(s, order, 5)
    for k in range(1, len(s)):
        a, b, n = order[k], order[k - 1], 0
        while n < 5 and max(a, b) + n < len(s) and s[a + n] == s[b + n] != 0:
            n += 1
        assert shared[k] == n


def plain_words(t):
    return re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c)[0] != "M").casefold())


def brute_leaks(docs, items):
    out = set()
    for d, t in docs:
        w = plain_words(t or "")
        for i, x in items:
            y = plain_words(x or "")
            n = min(12, len(y))
            grams = {tuple(y[k : k + n]) for k in range(len(y) - n + 1)} if n else set()
            if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)) and n:
                out.add((d, i))
    return out


@pytest.mark.parametrize("block", [2, 100])
def test_leaks_against_brute_force(spark, block):
    rng = random.Random(3)
    vocabulary = [f"pal{i}" for i in range(30)] + ["ação", "AÇÃO", "9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 5, 12, 20])))) for i in range(12)] + [(90, ""), (91, None), (92, "..."), (93, "pal1 pal2"), (94, "pal1 pal2")]
    docs = []
    for d in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 30))
        if d % 3 == 0:
            y = (items[d % 12][1]).split()
            a = rng.randint(0, max(0, len(y) - 12))
            w[5:5] = [x.upper().replace("Ç", "C") for x in y[a : a + rng.choice([11, 12, 13])]]
        docs.append((d, rng.choice([" ", "\n", ", ", "—"]).join(w)))
    docs += [(100, None), (101, ""), (102, "pal1 " * 20_000), (0, docs[0][1])]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items, "item_id long, text string")
    found = leak.leaks(df, it, block=block).select("doc_id", "item_id").distinct()
    assert {tuple(r) for r in found.collect()} == brute_leaks(docs, items)
    assert leak.leaked_pairs(df, it.limit(0)).count() == 0 and leak.leaked_pairs(df.limit(0), it).count() == 0


def test_spans_are_merged(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, f"x {text} x")], "doc_id long, text string")
    assert [tuple(r) for r in leak.leaks(df, spark.createDataFrame([(5, text)], "item_id long, text string")).collect()] == [(1, 5, 1, 30)]


DAMAGE = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp850")]
SOUND = ["Alteração do Estatuto Social, item 3", "SESSÃO DE AVALIAÇÃO – São Benício §601", "Aliança ÂMBAR®: CISÃO Nº 862", "Отчёт da controlada, nº 734", "Cotação em £ e € – 353", "Müller & Søn, foro de Île-Neuve", "PÃO™ e AÇÚCAR", "株主総会", "Tabela ± 44,7%: § 3º, 2ª série, «Âncora»", "¿Qué más?", "conside­rado", "ordiná¬", "🚀 👍🏽", "Divulgação", "m³ e 5º", ""]


def test_sound_texts_are_left_alone():
    for t in [*SOUND, None]:
        assert garble.restore(t) == (t, False, True)


@pytest.mark.parametrize(("meant", "read"), DAMAGE)
@pytest.mark.parametrize("text", ["Alteração do Estatuto, item 3", "Reunião sobre debêntures e ações", "Esclarecimentos sobre notícia", "Política de divulgação (versão 2)"])
def test_damage_is_undone(meant, read, text):
    bad = text.encode(meant).decode(read, "strict" if read != "cp1252" else "replace")
    if garble.REPLACEMENT in bad:
        pytest.skip("this text cannot be read wrongly that way")
    restored, found, complete = garble.restore(bad)
    assert found and complete and restored == text


def test_double_partial_and_lost():
    twice = "Negociação".encode().decode("cp1252").encode().decode("cp1252")
    assert garble.restore(f"{twice} e ação sã") == ("Negociação e ação sã", True, True)
    assert garble.restore("Ren�ncia")[1:] == (True, False)


def test_any_depth_and_escapes_alone():
    text = "Reunião de acionistas"
    for depth in range(1, 6):
        bad = text
        for _ in range(depth):
            bad = bad.encode().decode("latin-1")
        assert garble.restore(bad) == (text, True, True)
    assert garble.restore("S&atilde;o Paulo e S\\u00e3o Jos&#233;") == ("São Paulo e São José", True, True)
    for t in ("Banco &amp; Cia &lt;b&gt;", "R&D; x", "C:\\users\\u12", "&#10; a"):
        assert garble.restore(t) == (t, False, True)


def test_other_alphabets_and_halves():
    assert garble.restore("Привет".encode("cp1251").decode("latin-1")) == ("Привет", True, True)
    assert garble.restore("Łódź i żółć".encode().decode("cp1250", "ignore"))[1]
    assert garble.restore("Gdańsk".encode().decode("cp1250")) == ("Gdańsk", True, True)
    half = "Ren\ufffdncia"
    assert garble.restore(f"{half} e atÃ© hoje") == (f"{half} e até hoje", True, False)


def test_garbled_rows_of_both_tables(spark):
    ipe = spark.createDataFrame([(1, "atÃ© hoje"), (2, "até"), (3, None), (4, "")], "ipe_id long, assunto string")
    docs = spark.createDataFrame([(7, "x" * 50_000 + " papÃ©is", 1), (8, "ok", 1)], "doc_id long, text string, row_id int")
    assert {tuple(r)[:2] for r in garble.garbled_rows(ipe, docs).collect()} == {("ipe", 1), ("documents", 7)}
    assert garble.garbled_rows(ipe.limit(0), docs.limit(0)).count() == 0


def test_texts_the_pattern_refuses_are_unchanged(spark):
    """Every pair of misread encodings at every place of a word, and random neighbours of all characters that cost."""
    rng = random.Random(8)
    words = ["Reunião", "câmara", "público", "Área", "área", "Ética", "ação", "É", "índice", "(Órgão)", "São", "à vista", "d’água", "señor"]
    texts = ["Reuni„o", "c‚mara", "p˙blico", "ßrea"]
    for meant in ("utf-8", "cp1252"):
        for read in garble.CODECS:
            texts += [w.encode(meant).decode(read, "ignore") for w in words]
    chars = [*"ab Z1.(&", *sorted(garble._SYMBOLS | garble._USUAL | set(garble._RARE)), *"äöőřшЖλΣ株ﬁ\u00ad\u00a0\u0085\u02b0�─🚀ʰ"]
    texts += ["".join(rng.choices(chars, k=rng.randint(1, 5))) for _ in range(30_000)]
    texts += ["".join(rng.choices("ab äöëšžñý", k=12)) for _ in range(3_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    refused = [r.t for r in df.filter(~garble.suspects(F.col("t"))).select("t").collect()]
    assert len(refused) > 1_000 and not set(refused) & {"Reuni„o", "c‚mara", "p˙blico", "ßrea"}
    assert [t for t in refused if garble.restore(t)[1]] == []


TOXIC = ["cala a boca seu {} ninguem te perguntou", "voce e um {} some daqui agora", "gente como voce {} devia sumir"]
CALM = ["a receita liquida subiu no trimestre", "o conselho aprovou a emissao de debentures", "o codigo de conduta proibe insulto e assedio", "o papel fechou em alta com volume forte"]


def posts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.3
        body = rng.choices(CALM, k=3) + ([rng.choice(TOXIC).format(rng.choice(["imbecil", "canalha", "parasita"]))] if bad else [])
        rng.shuffle(body)
        text = ". ".join(body)
        if bad and rng.random() < 0.4:
            text = text.replace("imbecil", rng.choice(["1mb3cil", "i.m.b.e.c.i.l", "IMBECIIIL", "imb*cil"])).replace("boca", "b0ca")
        out.append((i, text, int(bad)))
    return out


def test_digits_spell_telling_words_only():
    spelling = abuse.Spelling({"idiota", "iso"})
    assert abuse.words("seu 1d10t4 e 150 no 3t20, 1T25 ou $1d10t4", spelling) == ["seu", "idiota", "e", "no", "ou"]
    assert abuse.words("seu 1d10t4", abuse.Spelling()) == ["seu"]


def test_held_out_accuracy(spark):
    rows = posts(600, 4)
    df = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, "s"), (901, "", "s"), (902, "x " * 30_000, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, b, "2024-01-01 00:00:00") for i, _, b in rows[:300]] + [(0, 1 - rows[0][2], "2023-01-01 00:00:00"), (None, 1, None), (5, None, None)], "doc_id long, toxic int, reviewed_at string")
    found = {r.doc_id for r in abuse.toxic_documents(df, labels).collect()}
    held = [(i, b) for i, _, b in rows[300:]]
    hit = sum(i in found for i, b in held if b)
    assert hit >= 0.95 * sum(b for _, b in held)
    assert sum(i in found for i, b in held if not b) <= 2 and not found & {900, 901, 902}
    scores = abuse.scored_documents(df, labels)
    assert scores.count() == 603
    assert abuse.toxic_documents(df, labels.limit(0)).count() == 0 and abuse.toxic_documents(df.limit(0), labels).count() == 0


def test_equal_examples_are_one_neighbour():
    """A passage that many calm and some toxic documents have is marked by their share, not by the first of them."""
    line, insult = np.array([1, 2, 3, 4, 5]), np.array([6, 7, 8])
    examples = abuse.Examples()
    for owner in range(150):
        examples.add(line, int(owner < 12), owner)
    for owner in (200, 201):
        examples.add(insult, 1, owner)
    judge = abuse.Judge(examples, abuse.Weights.of(1_000, np.array([150.0] * 5 + [2.0] * 3)))
    ids, first, end = np.concatenate([line, insult, insult]), np.array([0, 5, 8]), np.array([5, 8, 11])
    raw, near = judge.scores(ids, first, end, np.array([999, 999, 200]))
    assert raw[0] < 0.1 and raw[1] > 0.5 and raw[2] == raw[1] and (near >= 0).all()
    kept = abuse._edited(examples, judge.weights)
    assert [o for m, o in zip(kept.marks, kept.owners, strict=True) if m] == [200, 201]
    examples.add(np.array([9, 10, 11]), 1, 300)
    lone = abuse.Judge(examples, abuse.Weights.of(1_000, np.array([150.0] * 5 + [2.0] * 3 + [1.0] * 3)))
    assert lone.scores(np.array([9, 10, 11]), np.array([0]), np.array([3]), np.array([300]))[0][0] == 0  # nobody else has it


def test_examples_of_mistaken_marks_are_refused(spark):
    """A calm text marked toxic brings in the calm texts of its company; a single true example brings in the insults."""
    found = {"good": (40, 14, 14, 0.9), "lone": (4, 0, 0, 0.8), "mistake": (60, 2, 0, 0.6), "tiny": (1, 0, 0, 0.5)}
    assert abuse.refused_examples(found, (10_000, 600, 15)) == {"mistake"}
    assert abuse.refused_examples(found, (10_000, 3_500, 3_500)) == set()  # nor does a toxic mark ever refute
    alike = {"good": (400, 140, 140, 0.9), "unmarked": (60, 0, 0, 0.6)}
    assert abuse.refused_examples(alike, (10_000, 3_500, 80)) == set()  # toxic and other documents drawn alike tell nothing
    assert abuse.refused_examples({}, (0, 0, 0)) == set()
    insults = [t.format(w) for t in TOXIC for w in ("imbecil", "canalha", "parasita")]
    rng = random.Random(3)
    rows = [(i, " ".join(rng.sample(CALM, 3)) + ". " + insults[i % 9], 1) for i in range(120)]
    rows += [(i, " ".join(rng.sample(CALM, 3)) + ". a tiraquim que ontem cresceu", 0) for i in range(120, 132)]
    rows += [(i, " ".join(rng.sample(CALM, 3)), 0) for i in range(132, 4_000)]
    marks = [(i, 1, None) for i in range(60)] + [(120, 1, None)] + [(i, 0, None) for i in range(160, 360)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, reviewed_at string")
    assert sorted(r.doc_id for r in abuse.toxic_documents(df, labels).collect()) == list(range(120))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_block_max_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    vectors = [{int(t): float(w) for t, w in zip(rng.choice(40, 4, replace=False), rng.random(4), strict=True)} for _ in range(200)]
    owners = rng.integers(0, 5, 200)
    index = abuse.BlockMaxIndex(vectors, 40, owners)
    terms = np.stack([rng.choice(40, 3, replace=False) for _ in range(6)])
    weights, docs = rng.random((6, 3)), np.array([0, 1, 2, 3, 4, -1])
    ids, cos = index.nearest(terms, weights, 7, 0.3, docs)
    for q in range(6):
        every = sorted((-sum(w * v.get(int(t), 0) for t, w in zip(terms[q], weights[q], strict=True)), i) for i, v in enumerate(vectors) if owners[i] != docs[q])
        want = [(i, -s) for s, i in every if -s >= 0.3 + 1e-6][:7]
        assert np.allclose([c for _, c in want], cos[q][: len(want)], atol=1e-5) and (ids[q] >= 0).sum() >= len(want)
        assert not (owners[ids[q][ids[q] >= 0]] == docs[q]).any()


def test_bound_loses_no_neighbour():
    """Every stretch within the radius of a positive example is among the passages that are searched."""
    rows = posts(200, 12)
    number = {}
    abuse.numbered(pa.array([t for _, t, _ in rows]), abuse.Numbers(number, abuse.Spelling(), grow=True))
    df = Counter(w for _, t, _ in rows for w in set(abuse.words(t, abuse.Spelling())))
    model = abuse.fit(rows, len(rows), df)
    judge = abuse.Judge(model.examples, model.weights)
    ids, starts = abuse.numbered(pa.array([t for _, t, _ in posts(60, 13)]), model.numbers())
    text, first, end = abuse.windows(ids, starts, judge.told)
    near, _ = judge.nearest(ids, first, end, np.full(len(first), -1))
    positive = ((near >= 0) & (judge.marks[near] > 0)).any(1)
    kept = {(int(f), int(e)) for f, e in zip(*judge.passages(ids, starts)[1:], strict=True)}
    assert positive.any() and {(int(f), int(e)) for f, e in zip(first[positive], end[positive], strict=True)} <= kept


def test_words_are_numbered_per_text():
    numbers = {}
    texts = [None, "", "b0ca s o m e daqui", "a b", "c d e, fim", "  x\ny  "]
    ids, starts = abuse.numbered(pa.array(texts, pa.string()), abuse.Numbers(numbers, abuse.Spelling(), grow=True))
    names = {i: w for w, i in numbers.items()}
    assert [[names[i] for i in ids[a:b]] for a, b in zip(starts, starts[1:], strict=False)] == [[], [], ["boca", "some", "daqui"], ["a", "b"], ["cde", "fim"], ["x", "y"]]


def test_calibration_is_monotone_and_pooled():
    steps = abuse.calibration([(0.2, 0), (0.3, 1), (0.4, 0), (0.8, 1), (0.9, 1)])
    assert [s for s, _ in steps] == [0.2, 0.3, 0.8] and [p for _, p in steps] == sorted(p for _, p in steps)
    assert abuse.calibration([]) == []


def scanned_corpus():
    rng = random.Random(9)
    base = "o conselho de administração aprovou a emissão de debêntures simples no montante previsto para o exercício seguinte conforme correspondência recebida da companhia e o volume considerado".split()
    wide = [(i, " ".join(rng.choices(base, k=60)) + " sócio-gerente pós-fixado.") for i in range(60)]
    pages = []
    for d in range(100, 108):
        body = iter(textwrap.wrap(" ".join(rng.choices(base, k=400)), 64))
        text = ["Casa Nova Energia S.A., folhas avulsas 2019"]
        for page in range(1, 4):
            text += [next(body) for _ in range(6)] + [f"           - {page} -", "Casa Nova Energia S.A., folhas avulsas 2019"]
        pages.append((d, text[:-1]))
    return wide, pages


def test_scanned_pages(spark):
    wide, pages = scanned_corpus()
    want = set()
    for d, lines in pages:
        for i, x in enumerate(lines, 1):
            if "folhas" in x or x.strip().startswith("-"):
                want.add((d, i, "furniture"))
    d, lines = pages[0]
    lines[2] = lines[2] + " recebi-"
    lines[3] = "da " + lines[3]
    want.add((d, 3, "hyphen"))
    lines[4] = lines[4] + " sócio-"
    lines[5] = "gerente " + lines[5]
    d2, more = pages[1]
    more[3] = "confonne aprovou a ernissão " + more[3][20:]
    want.add((d2, 4, "char"))
    more[6] = "debên-"
    more[7], more[8] = more[7], more[8]
    df = spark.createDataFrame([*wide, *((a, "\n".join(b)) for a, b in pages), (500, None), (501, ""), (502, "x" * 60_000)], "doc_id long, text string")
    found = {tuple(r) for r in scans.ScannedPages(df).findings().collect()}
    assert {f for f in found if f[0] not in (d2,)} == {w for w in want if w[0] not in (d2,)}
    assert (d2, 4, "char") in found
    flowed = {r.doc_id: r.text for r in scans.ScannedPages(df).paragraphs().collect()}
    assert "folhas avulsas" not in flowed[d] and "recebida" in flowed[d] and "sócio-gerente" in flowed[d] and "emissão" in flowed[d2]
    assert scans.ScannedPages(df.limit(0)).findings().count() == 0


@pytest.mark.parametrize(("line", "number"), [("- 1 -", 1), ("  Página 3 de 9\x0c", 3), ("FOLHA 2/6", 2), ("[ 4 ]", 4), ("iv", 0), ("7.211.919", None), ("Rubrica: ____  Pág. 8", 8), ("em 2023.", None)])
def test_page_marks(line, number):
    assert scans.page_mark(line)[2] == number
