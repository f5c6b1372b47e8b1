import math
import random

import pyarrow.dataset as ds
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from joinery.llm import leaks, prose, quality, tokens
from joinery.llm.words import sentences, words

DOC = "doc_id bigint, text string"
ENCODER = tokens.PrefixEncoder(open(tokens.VOCABULARY, "rb").read())
REFERENCE = tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcAB éß木*-_1'\n\t \U0001f600́"), max_size=40), max_size=20))
def test_prefix_encoder(ws):
    got = ENCODER.encode(set(ws))
    for w in ws:
        assert list(got[w]) == (REFERENCE._core_bpe.encode_single_piece(w.encode()) if w else [])


def test_encode_table(spark):
    long = " ".join(f"word{i % 97}*" * 3 for i in range(5000)) + "=" * 20000
    rows = [(1, "Hello  world"), (2, ""), (3, None), (4, "<|endoftext|> x"), (5, "\r\n 　a"), (6, long), (1, "Hello  world"), (None, "x")]
    docs = spark.createDataFrame([(*r, "e", 1) for r in rows], DOC + ", ids string, row int")
    got = tokens.encode_table(docs).collect()
    assert len(got) == 8
    by_id = {r["doc_id"]: r["ids"] for r in got}
    for i, t in rows[:6]:
        assert by_id[i] == (REFERENCE.encode_ordinary(t) if t else [])
        assert REFERENCE.decode(by_id[i]) == (t or "")
    assert tokens.encode_table(docs.filter("false")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_encode_corpus(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    want = {r["doc_id"]: REFERENCE.encode_ordinary(r["text"] or "") for r in ds.dataset(path).to_table(columns=["doc_id", "text"]).to_pylist()}
    assert {r["doc_id"]: r["ids"] for r in tokens.encode_table(spark.read.parquet(path)).collect()} == want


def test_words():
    same = ["Der grüne Holz Rahmen", "DER GRÜNE, Holz-\n> Rahmen", "<p>Der grüne</p> **Holz** Rahmen", "Der gr&uuml;ne Ho­lz Rahmen", "Der grüne Holz Rah-\r\nmen", "ＤＥＲ [grüne](http://a.b) H̶o̶lz​ Rahmen"]
    assert words(same[0]) == ["der", "grüne", "holz", "rahmen"]
    assert words(same[1]) == ["der", "grüne", "holzrahmen"]  # a word broken at the line's end
    for s in same[2:]:
        assert words(s) == words(same[0]), s
    assert words(None) == words("") == words(" \n") == []
    assert sentences("A b c. D e! F") == [["a", "b", "c"], ["d", "e"], ["f"]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=3, max_size=5), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=30))
def test_wu_manber(pats, text):
    found = {tuple(p): {i} for i, p in enumerate(pats)}
    got = leaks.WuManber(found).search(text)
    want = set().union(*[v for p, v in found.items() if any(tuple(text[k : k + len(p)]) == p for k in range(len(text)))], set())
    assert got == want


ITEM = "item_id int, text string, benchmark string"


def runs_by_hand(items, least=10):
    """Shortest runs of one item only, by trying every run against every other item."""
    streams = [(i, words(t)) for i, t in items]
    stands = lambda w, run: any(w[k : k + len(run)] == run for k in range(len(w) - len(run) + 1))
    out = set()
    for i, text in items:
        for s in sentences(text):
            for k in range(len(s) - least + 1):
                for n in range(least, len(s) - k + 1):
                    if not any(stands(w, s[k : k + n]) for j, w in streams if j != i):
                        out.add((i, tuple(s[k : k + n])))
                        break
    return out


def test_patterns_against_brute_force(spark):
    rng = random.Random(6)
    stock = [" ".join(rng.choices("abcdef", k=rng.randint(8, 90))) for _ in range(5)]
    items = [(i, ". ".join([*rng.sample(stock, 2), " ".join(rng.choices("abcdef", k=rng.randint(5, 25))), stock[0] + f" end{i} tail"]) + ".") for i in range(7)]
    items += [(8, items[0][1]), (9, "too short"), (10, None), (11, "")]
    df = spark.createDataFrame([(i, t, "b") for i, t in items + items[:1] + [(None, stock[0])]], ITEM)
    got = {(r["item_id"], tuple(r["run"])) for r in leaks.patterns(df).collect()}
    assert got == runs_by_hand([x for x in items if x[1]]) and len(got) > 50
    assert leaks.patterns(df.filter("false")).count() == 0


def test_shards_change_nothing(spark):
    one = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, f"{one} eleven.", "b"), (2, f"{one} twelve.", "b"), (3, " ".join(f"u{i}" for i in range(14)), "b")], ITEM)
    docs = spark.createDataFrame([(7, one), (8, f"x {one} eleven"), (9, " ".join(f"u{i}" for i in range(14)) + " " + one + " twelve")], DOC)
    for shard in (100, 2, 1):
        assert sorted(map(tuple, leaks.find_leaks(docs, items, shard=shard).collect())) == [(8, 1), (9, 2), (9, 3)], shard
    docs, items = spark.read.parquet(CORPUS), spark.read.parquet(CORPUS.replace("documents", "eval_items"))
    whole = leaks.find_leaks(docs, items)
    parts = leaks.find_leaks(docs, items, shard=-(-leaks.patterns(items).count() // 4))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_find_leaks(spark):
    s = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda."
    items = spark.createDataFrame([(1, s, "b"), (2, "Too short.", "b"), (3, None, "b"), (4, "Other words entirely: " + " ".join(f"w{i}" for i in range(12)), "b")], "item_id int, text string, benchmark string")
    rows = [(1, "x " * 50000 + s), (2, s.upper().replace(" ", "\n> ")), (3, s.replace("epsilon", "epsi-\nlon")), (4, s.replace("zeta", "really zeta")), (5, None), (6, ""), (7, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 " + s), (7, s), (None, s)]
    docs = spark.createDataFrame([(*r, "src", 0) for r in rows], DOC + ", source string, item_id int")
    got = sorted(map(tuple, leaks.find_leaks(docs, items).collect()))
    assert got == [(1, 1), (2, 1), (3, 1), (7, 1), (7, 4)]
    assert leaks.find_leaks(docs.filter("false"), items).count() == 0 and leaks.find_leaks(docs, items.filter("false")).count() == 0
    assert leaks.leak_report(docs, items).first()["documents"] == 4


PROSE = [
    "The first attempt fell over in the end; the second one has a low base and stays where it is.",
    "IT WOULD BE BETTER TO START WITH THE FOOT AND LEAVE THE RAIL FOR THE END.",
    "so nobody had told the crew that the boards were still wet and they put it down in the hall",
    "> The buyer wrote that\n> the steps were in the\n> wrong order, and they\n> were right.",
    "A: The old bench is too low for a hall.\nB: A new one is on the way, and it will be a bit higher.",
    "Das Kind hat sich auf den Schemel gestellt, und er hat es ohne Knarren getragen.",
    "La table est restée dans l'atelier et elle ne bouge toujours pas.",
    "En el dibujo todo parece recto, pero el tablero se hunde en el centro.",
    "Stół jest za niski i dlatego nie da się przy nim wygodnie siedzieć.",
    "Стол слишком низкий, и поэтому за ним не так удобно сидеть весь день.",
]
OTHER = [
    "- Leg: oak, 20 mm.\n- 5 x rail, birch\n- Clamp",
    "piece,wood,dx\nleg,oak,10\nrail,ash,20",
    "| piece | wood |\n|---|---|\n| leg | oak |",
    "for i in range(19): acc[i] += 3\nif acc > 79: return None",
    "Home / Next / Print / Search / Sale / Help / Home / Print",
    "*" * 300,
    "10 20 30 40 50 60 0 0 0\n11 21 31 41 51 61 0 0 0",
    "the not of and carries no the is it the of was a in had they the a because the with to the from a of an is the",
    "light cherry shelf narrow oak bench plain ash desk stiff pine chair",
]


CORPUS = "/root/testdata/sf0.01/documents.parquet"
# Sentences of languages that the test corpus doesn't have.
FOREIGN = {
    "it": [
        "Il tavolo è troppo basso per la cucina e non si può lavorare bene.", "La sedia che abbiamo costruito ieri è più solida di quella vecchia.", "Non c'era più spazio per il martello e la sega nella cassetta.",
        "Dopo la colla bisogna aspettare fino a sera e poi si può levigare.", "Mio fratello ha detto che il letto era troppo grande per la stanza.", "Se la porta non si chiude bene, è meglio togliere un po' di legno.",
        "Ho visto che il ripiano della libreria non era in piano e si muoveva.", "Per fare il cassetto ci vogliono due ore e un po' di pazienza.", "La gamba che è stata tagliata male si trova sotto il banco con le altre.",
        "Quando la vernice è asciutta si può portare la panca nel giardino.", "Il cliente voleva una scatola con quattro piedi e non un armadio.", "Alla fine abbiamo tenuto la versione che era più leggera da portare.",
    ],
    "pt": [
        "A mesa é muito baixa para a cozinha e não dá para trabalhar bem.", "A cadeira que fizemos ontem é mais firme do que a velha.", "Não havia mais espaço para o martelo e a serra na caixa.",
        "Depois da cola é preciso esperar até à noite e só então lixar.", "O meu irmão disse que a cama era grande demais para o quarto.", "Se a porta não fecha bem, é melhor tirar um pouco de madeira.",
        "Vi que a prateleira da estante não estava direita e mexia muito.", "Para fazer a gaveta são precisas duas horas e um pouco de calma.", "A perna que foi mal cortada está debaixo do banco com as outras.",
        "Quando o verniz está seco pode levar-se o banco para o jardim.", "O cliente queria uma caixa com quatro pés e não um armário.", "No fim ficámos com a versão que era mais leve para levar.",
    ],
    "nl": [
        "De tafel is te laag voor de keuken en je kunt er niet goed aan werken.", "De stoel die we gisteren hebben gemaakt is steviger dan de oude.", "Er was geen plaats meer voor de hamer en de zaag in de kist.",
        "Na het lijmen moet je wachten tot de avond en dan kun je schuren.", "Mijn broer zei dat het bed te groot was voor de kamer.", "Als de deur niet goed sluit, is het beter om wat hout weg te halen.",
        "Ik zag dat de plank van de kast niet recht was en dat hij bewoog.", "Om de lade te maken heb je twee uur en een beetje geduld nodig.", "De poot die verkeerd is gezaagd ligt onder de bank met de andere.",
        "Als de lak droog is kan de bank naar de tuin worden gebracht.", "De klant wilde een doos met vier poten en niet een kast.", "Op het einde hebben we de versie gehouden die lichter was om te dragen.",
    ],
}


def wrapped(text, width):
    out = [""]
    for w in text.split():
        if out[-1] and len(out[-1]) + len(w) >= width:
            out.append(w)
        else:
            out[-1] = f"{out[-1]} {w}".strip()
    return "\n".join(out)


@pytest.fixture(scope="module")
def lexicon(spark):
    """What the documents of the test tables teach; they have no Polish, Russian or Japanese."""
    return quality.learn(spark.read.parquet(CORPUS))


def test_prose_and_other(lexicon):
    foreign = [s for texts in FOREIGN.values() for s in (" ".join(texts[:5]), wrapped(" ".join(texts), 40), " ".join(texts[5:]).lower())]
    japanese = "このテーブルは台所には低すぎるので、\n座って作業するのが難しいです。明日もう一度、\n脚を長くしてみます。"
    for t in PROSE + foreign + [japanese]:
        assert prose.measure(t, lexicon)[1]["outside"] < 0.5, t
    for t in OTHER + ["buy now " * 40, "A: 1\nB: 2\n" * 30, "€â¿Ã ©â Â¼Â¼ € ¿Ã " * 20]:
        assert prose.measure(t, lexicon)[1]["outside"] > 0.5, t
    for t in (None, "", " \n\t"):
        assert prose.measure(t, lexicon) == ("none", dict.fromkeys(prose.STATS, 0.0))
    assert prose.measure("Das Brett ist noch nicht trocken, und wir warten auf den Nachbarn.", lexicon)[0] == "de"


def test_strewn_words_of_languages_learned_from_the_corpus(spark):
    """Words of Italian, Portuguese and Dutch sentences in random order are found; the sentences are not, whatever their labels."""
    rng = random.Random(8)
    natural = {lang: [" ".join(rng.sample(texts, 5)) for _ in range(150)] for lang, texts in FOREIGN.items()}
    strewn = {lang: [] for lang in FOREIGN}
    for lang, texts in FOREIGN.items():
        bag = [w.strip(".,").lower() for s in texts for w in s.split()]
        strewn[lang] = [" ".join(rng.choices(bag, k=120)) for _ in range(8)]
    rows = [(t, lang) for lang in FOREIGN for t in natural[lang]] + [(t, lang) for lang in FOREIGN for t in strewn[lang]]
    rows = [(10_000_000 + i, t, lang if rng.random() < 0.8 else rng.choice(["en", None, "und"])) for i, (t, lang) in enumerate(rows)]
    docs = spark.read.parquet(CORPUS).select("doc_id", "text", "lang").union(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = {r["doc_id"] for r in quality.not_prose(docs).collect() if r["doc_id"] >= 10_000_000}
    assert got == {10_000_000 + 450 + i for i in range(24)}
    # copies of a strewn text do not teach its order
    copies = spark.createDataFrame([(20_000_000 + i, strewn["it"][0], "it") for i in range(600)], "doc_id bigint, text string, lang string")
    assert quality.not_prose(docs.union(copies)).filter("doc_id >= 20000000").count() == 600


def test_exact_ranks(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["en", "de"]), *[float(rng.randint(0, 5)) for _ in prose.STATS]) for i in range(500)]
    stats = spark.createDataFrame(rows, "doc_id bigint, language string, " + ", ".join(f"{s} double" for s in prose.STATS))
    got = quality.ranks(stats).collect()
    assert len(got) > 20
    for r in got:
        mine = [x[2 + prose.STATS.index(r["stat"])] for x in rows if x[1] == r["language"]]
        assert (r["below"], r["upto"], r["total"]) == (sum(v < r["value"] for v in mine), sum(v <= r["value"] for v in mine), len(mine))
    assert quality.ranks(stats.filter("false")).count() == 0


def test_not_prose(spark):
    texts = PROSE + OTHER + [None, "", "  \n"] + PROSE[:2] * 20
    mine = [(5000 + i, t, "x", 0.0) for i, t in enumerate(texts)] + [(5000 + len(PROSE), OTHER[0], "x", 0.0), (None, OTHER[0], "x", 0.0)]
    docs = spark.createDataFrame(mine, DOC + ", language string, score double").unionByName(spark.read.parquet(CORPUS).selectExpr("doc_id", "text", "'y' as language", "1D as score"))
    got = {r["doc_id"] for r in quality.not_prose(docs).filter("doc_id >= 5000").collect()}
    assert got == set(range(5000 + len(PROSE), 5000 + len(PROSE) + len(OTHER)))
    assert quality.scored(docs).filter(f"doc_id = {5000 + len(PROSE)}").count() == 2
    assert quality.not_prose(docs.filter("false")).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " ")], DOC)
    assert {tuple(r)[1:2] + (r["score"], r["outlier"]) for r in quality.scored(blank).collect()} == {("none", 0.0, 0.0)}
    long = docs.select("doc_id", "text").union(spark.createDataFrame([(9001, PROSE[0] + "\n" + "x=1;\n" * 100000), (9002, PROSE[0] * 3000)], DOC))
    assert [r["doc_id"] for r in quality.not_prose(long).filter("doc_id > 9000").collect()] == [9001]


def test_scores_decide(spark):
    """The score is 1 or more exactly where a tail is no larger than that of the documents beyond a limit; brute force over all documents."""
    docs = spark.read.parquet(CORPUS)
    rows = quality.scored(docs).toPandas()
    for lang, group in rows[rows.language != "none"].groupby("language"):
        for r in group.itertuples():
            want = False
            for stat, limit in quality.LIMITS.items():
                values = group[stat]
                want |= bool((values >= getattr(r, stat)).sum() <= (values > limit).sum())
            assert want == (r.score >= 1), r.doc_id
            tails = [((group[s] <= getattr(r, s)).mean(), (group[s] >= getattr(r, s)).mean()) for s in prose.STATS]
            lo, hi = [[-math.log(t[k]) for t in tails] for k in (0, 1)]
            assert r.outlier == pytest.approx(max(sum(lo), sum(hi), sum(map(max, lo, hi))))
    all_other = spark.createDataFrame([(i, f"{i} {i} 3 0 0\n" * 5) for i in range(20)], DOC)
    assert quality.not_prose(all_other).count() == 20
