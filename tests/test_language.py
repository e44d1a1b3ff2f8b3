import pytest

from trailhead.functions import languages as L
from trailhead.functions import russian as ru
from trailhead.plans import language as Q


@pytest.mark.parametrize(
    "text, want",
    [
        ("boat", "boat"),
        ("((boat))", "boat"),
        ("boat quay stone", "(AND boat quay stone)"),
        ("boat and quay", "(AND boat quay)"),
        ("or-else x_1", "(AND or-else x_1)"),
        ("grain | boat quay", "(OR grain (AND boat quay))"),
        ("stone (boat OR grain) NOT late", "(AND stone (OR boat grain) (NOT late))"),
        ("stone -(late OR old)", "(AND stone (NOT (OR late old)))"),
        ('" old   bridge "', '"old   bridge"'),
        ('~"узкая улица" ~сад -роза', '(AND ~"узкая улица" ~сад (NOT роза))'),
    ],
)
def test_canonical(text, want):
    assert Q.canonical(Q.parse(text).root) == want


def test_canonical_forms_are_read_back():
    """A tree written without its operators' names and read again is the same tree."""

    def written(node):
        if isinstance(node, Q.Not):
            return f"-{written(node.child)}"
        if isinstance(node, Q.And | Q.Or):
            return "(" + (" " if isinstance(node, Q.And) else " | ").join(map(written, node.children)) + ")"
        return Q.canonical(node)

    for text in ("stone (boat OR grain) NOT late", 'a ("b c" | d -e) ~f', "a | (b -c) | d"):
        once = Q.parse(text).root
        assert Q.canonical(Q.parse(written(once)).root) == Q.canonical(once)


def test_language_directive():
    last = Q.parse("lang:fr-CA quay lang:De")
    assert (last.language, Q.canonical(last.root)) == ("de", "quay")
    assert Q.parse("lang:fr-CA quay").language == "fr" and Q.parse("quay").language == ""


#: A query of each rule that is broken.
REJECTED = {
    "no words": ["", " \t ", "lang:fr"],
    "an open end": ['"old bridge', "(boat | quay", "quay )"],
    "nothing positive": ["-boat", "NOT boat", "(-boat -quay) stone", "quay | -boat"],
    "an empty operand": ['""', "~", "~ quay", "quay OR", "lang: quay"],
    "a negated negation": ["stone NOT NOT boat"],
}


@pytest.mark.parametrize("text", [x for group in REJECTED.values() for x in group])
def test_rejected(text):
    with pytest.raises(Q.QueryError):
        Q.parse(text)


def test_russian_analyses():
    assert ru.lemma_set("улицы")[0] == "улицы" and "улица" in ru.lemma_set("улицы")
    assert ru.analyze("quay") == [] and ru.lemma_set("") == []
    for w in ("улицами", "старая", "играют", "садом"):
        found = ru.analyze(w)
        assert found == ru.analyze(w.upper()) and len(ru.lemma_set(w)) <= L.MOST_LEMMAS
        assert [a.confidence for a in found] == sorted((a.confidence for a in found), reverse=True)
        assert any(a.paradigm == "surface" and a.lemma == w for a in found)


def test_russian_forms():
    forms = [f.form for f in ru.expand("улица")]
    assert {"улицы", "улице", "улицу", "улицами"} <= set(forms) and "улица" not in forms
    assert len(forms) <= ru.MOST_FORMS and len(set(forms)) == len(forms)
    assert ru.expand("зелёная")[0][:2] == ("зеленая", "accent")
    assert ru.expand("quay") == [] and ru.expand("улица", 2) == ru.expand("улица")[:2]
    # every form of an irregular word leads back to it
    for lemma, (_, spelled) in ru.IRREGULAR.items():
        for form in spelled.split():
            assert lemma in ru.lemma_set(form, 99), (lemma, form)


def test_adapters():
    assert L.adapter("ru-BY") is L.RUSSIAN and L.adapter("EN_nz") is L.ENGLISH and L.adapter("tlh") is L.NONE
    assert [L.english_lemma(w) for w in ("Boats", "boss", "bus", "Runners")] == ["boat", "boss", "bus", "run"]
    assert L.ENGLISH.expand("run") == ["runners"] and L.NONE.expand("run") == []
