"""Stems, codings, brackets and mixtures against plain expectations; every coding is undone exactly."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.functions import coding, contexts, spans, stemming
from quillstone.functions.text import causal_bits

# From the sample vocabulary published with the algorithm (snowballstem.org, the English stemmer).
PUBLISHED = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist",
    "consistent": "consist", "consistently": "consist", "consisting": "consist", "consists": "consist", "consolation": "consol", "consolations": "consol", "consolatory": "consolatori",
    "console": "consol", "consoled": "consol", "consoles": "consol", "consolidate": "consolid", "consolidated": "consolid", "consolidating": "consolid", "consoling": "consol",
    "consolingly": "consol", "consols": "consol", "consonant": "conson", "consort": "consort", "consorted": "consort", "consorting": "consort", "conspicuous": "conspicu",
    "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirator": "conspir", "conspirators": "conspir", "conspire": "conspir", "conspired": "conspir", "conspiring": "conspir",
    "constable": "constabl", "constables": "constabl", "constance": "constanc", "constancy": "constanc", "constant": "constant",
    "knack": "knack", "knackeries": "knackeri", "knacks": "knack", "knag": "knag", "knave": "knave", "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "kneading": "knead",
    "knee": "knee", "kneel": "kneel", "kneeled": "kneel", "kneeling": "kneel", "kneels": "kneel", "knees": "knee", "knell": "knell", "knelt": "knelt", "knew": "knew", "knick": "knick",
    "knife": "knife", "knight": "knight", "knightly": "knight", "knights": "knight", "knit": "knit", "knits": "knit", "knitted": "knit", "knitting": "knit", "knives": "knive",
    "knob": "knob", "knobs": "knob", "knock": "knock", "knocked": "knock", "knocker": "knocker", "knockers": "knocker", "knocking": "knock", "knocks": "knock", "knot": "knot", "knots": "knot",
}
# What the additions give: the expected stems are the plain words, or those of their plain words.
ADDED = {
    "irregular": ("regular", "Prefix"), "overcome": ("come", "Prefix"), "unnatural": ("natur", "Prefix"), "antisocial": ("antisoci", "Adjective"), "anti-social": ("social", "Prefix"), "dis-like": ("like", "Prefix"),
    "biggest": ("big", "Adjective"), "widest": ("wide", "Adjective"), "happiest": ("happi", "Adjective"), "strongest": ("strong", "Adjective"), "largest": ("larg", "Adjective"), "nicest": ("nice", "Adjective"),
    "can't": ("can", "Prefix"), "won't": ("will", "Prefix"), "shan't": ("shall", "Prefix"), "didn't": ("did", "Prefix"), "childhood": ("child", None), "hopeless": ("hope", "Adjective"),
    "honest": ("honest", None), "forest": ("forest", None), "best": ("best", None), "oddest": ("odd", "Adjective"),
    "cities": ("citi", "Plural"), "tied": ("tie", "Verb"), "quickly": ("quick", "AdverbOfManner"), "the": ("the", "Article"), "she": ("she", "Female"), "and": ("and", "Conjunction"), "under": ("under", "Adposition"),
    "skies": ("sky", "Noun"), "inning": ("inning", "Noun"), "dogs'": ("dog", "Plural"), "''dog''": ("dog", None), "": ("", None), "-": ("", None),
}


def test_stems_equal_the_published_ones():
    assert {w: stemming.stem(w)[0] for w in PUBLISHED} == PUBLISHED


def test_additions_to_the_stemmer():
    for word, (root, kind) in ADDED.items():
        found, types = stemming.stem(word)
        assert found == root and (kind in types if kind else stemming.word_type(types) in (14, 15)), word
    assert [stemming.word_type(stemming.stem(w)[1]) for w in ("running", "skies", "biggest", "he", "she", "the", "and", "under", "cities", "thus", "quickly", "anti-x", "table")] == [1, 2, 3, 4, 5, 6, 7, 8, 10, 9, 11, 15, 15]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abeioysltndgr'-", max_size=14))
def test_any_word_has_a_stem(word):
    s, types = stemming.stem(word)
    assert len(s) <= len(word) + 1 and 1 <= stemming.word_type(types) <= 15


PIECES = ["&amp;", "&quot;", "&lt;", "&gt;", "&amp;nbsp;", "&amp;quot;", "&amp;#960;", "&amp;#0960;", "&amp;#55300;", "\x03", "\x05", "&", '"', "!", "°", "a", "\n", "<"]


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=9).map("".join))
def test_entities_come_back(text):
    assert coding.grow_entities(coding.shrink_entities(text)) == text


def test_short_entities():
    assert coding.shrink_entities("&amp;nbsp;&lt;b&gt; &amp;#960; &amp;x") == "&&!&<b&> \x05π &&x"


WORDS = ["the", "capital", "international", "abc"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(4500)]
CODE = coding.WordCode(WORDS)


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(["the", "The", "THE", "tHe", "internationally", "xinternational", "INTERNATIONALx", " ", "é", "\x06", "\x07", "@", "\x0c", "A", "Ab", "ABc", "waaa", "Wzcb", "x" * 40, "1"]), max_size=8).map("".join))
def test_words_come_back(text):
    assert CODE.decode(CODE.encode(text.encode())) == text.encode()


def test_code_lengths_and_parts():
    sizes = [len(CODE.codes[w]) for w in WORDS]
    assert sizes == [1] * 80 + [2] * 3840 + [3] * (len(WORDS) - 3920) and len(set(CODE.codes.values())) == len(WORDS)
    assert CODE.encode(b"xinternational") == b"x" + CODE.codes["international"] and CODE.encode(b"The") == b"\x40" + CODE.codes["the"]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400))
def test_coder_comes_back(raw):
    assert coding.Coder.decode(coding.Coder.encode(raw), len(raw)) == raw


def test_coder_saves_on_even_text():
    assert len(coding.Coder.encode(b"a" * 5000)) < 40


def test_bracket_pairs():
    assert contexts.bracket_pairs("(a[b])x)<" + "y" * 300 + ">{") == {("[", 2): 1, ("(", 5): 1, ("<", 255): 1}


def test_mixture_is_the_mean_of_probabilities():
    text = "abracadabra abracadabra"
    *orders, mixed = contexts.mixed_bits(text)
    for order, bits in enumerate(orders):
        assert abs(bits - 8 * order - causal_bits(text, order)[1].sum()) < 1e-9
    assert abs(mixed + math.log2(sum(2.0 ** -(b - min(orders)) for b in orders) / 3) - min(orders)) < 1e-9
    assert contexts.mixed_bits(None) == [0.0] * 4 and contexts.mixed_bits("é")[2] == 16.0


# What stands at the end of each text, by hand.
URLS = {
    "http://books.test": "domain", "https://books.test/": "path_segment", "ftp://mirror.test/dumps/a.gz": "extension", "//static.books.test/logo.svg": "extension", "www.books.test/shelf": "path_segment",
    "url=books.test/shelf": "path_segment", "https://books.test/caf%C3%A9": "path_segment", "https://books.test/Ada_(poet)": "path_segment", "https://me@books.test:81/shelf": "path_segment",
    "https://[fe80::7]/a.htm": "extension", "https://books.test/find.cgi?q=ink&page=3": "query_value", "https://books.test/shelf/77": "path_segment", "Read https://books.test/shelf. ": "outside",
    "[https://books.test/shelf title]": "outside", "https://books.test/" + "z" * 4097: "outside", "[https://books.test/shelf]": "outside", "(https://books.test/shelf)": "outside",
    "https://books.test/s?k": "query_key", "https://books.test/#k": "fragment", "": "outside", "no link here": "outside",
}


def test_url_states():
    assert {t: spans.url_state(t).role for t in URLS} == URLS
    assert spans.url_state("urlMhttpsJ//books.test/sOkMv", aliased=True).role == "query_value" and spans.url_state(None) == spans.OUTSIDE
    assert spans.url_state("[https://[fe80::7]/k").role == "path_segment" and spans.url_state("[https://[fe80::7]/k]").role == "outside"
    assert spans.url_state("at https://[fe80::7]/a.htm").host == "[fe80::7]"
