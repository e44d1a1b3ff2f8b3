"""Small corpora with the shape of the chunk table."""

import hashlib
import re
from datetime import UTC, datetime

from trailhead import schema
from trailhead.functions import languages as L
from trailhead.plans import language as Q


def at(hour, minute=0):
    return datetime(2024, 6, 1, hour, minute, tzinfo=UTC)


MARKS = dict(
    sense_ids=["vessel", "hull"], concept_ids=["shipping"], attestation_ids=["logbook-7"], register="nautical", region="north",
    time_period="1890s", lexicon_source_id="almanac", source_authority="harbour-office",
)

#: A harbour town: (chunk, source, text, language, further columns).
TOWN = [
    ("quay", "w1", "boats moored along the stone quay", "en", MARKS),
    ("grain", "w2", "the grain harvest came late", "en", dict(sense_ids=["harvest"])),
    ("race", "w3", "forty runners crossed the old bridge", "en", {}),
    ("course", "w4", "les coureurs traversent le vieux pont", "fr", {}),
    ("hull", "w5", "boats", "en", MARKS),
    ("alarm", "w6", "alarm raised in hall two", "en", dict(temporal=(at(9, 15), at(10), "occurred", at(11)))),
    ("drill", "w7", "alarm tested after supper", "en", dict(temporal=(at(20), at(21), "occurred", at(22)))),
    ("lane", "u1", "Дети играли на узкой улице до вечера", "ru", {}),
    ("repair", "u2", "Главная улица закрыта из-за ремонта", "ru", {}),
    ("lake", "u3", "Белые птицы летят над тихим озером", "ru", {}),
    ("garden", "u4", "Сад цветёт рядом со старой мельницей", "ru", {}),
    ("roses", "u5", "Садовник поливает розы", "ru", {}),
    ("spruce", "u6", "У калитки стоит зеленая ель", "ru", {}),
]


def chunks(spark, rows, project="town", snapshot="first", trust="project", tombstoned=()):
    out = []
    for chunk, source, text, language, more in rows:
        row = dict.fromkeys(schema.CHUNKS.fieldNames())
        row |= {n: [] for n in ("lemmas", "wordforms", "sense_ids", "concept_ids", "attestation_ids")}
        row |= dict(
            project_id=project, snapshot_id=snapshot, chunk_id=chunk, source_id=source, span_start=0, span_end=len(text.encode()), text=text,
            text_checksum=hashlib.sha256(chunk.encode()).hexdigest(), trust_level=trust, language=language, tombstoned=chunk in tombstoned,
        ) | more
        out.append(tuple(row[n] for n in schema.CHUNKS.fieldNames()))
    return spark.createDataFrame(out, schema.CHUNKS)


def plain_answer(rows, text, language):
    """The chunks that a query matches, by walking its tree over each text's words."""
    adapter = L.adapter(language)
    answer = []
    for chunk, _, body, *_ in rows:
        words = re.findall(r"[^\W_]+(?:[-_][^\W_]+)*", body)

        def holds(node):
            if isinstance(node, Q.Not):
                return not holds(node.child)
            if isinstance(node, Q.And):
                return all(map(holds, node.children))
            if isinstance(node, Q.Or):
                return any(map(holds, node.children))
            if isinstance(node, Q.Term):
                return bool({adapter.norm_word(w) for w in words} & {adapter.norm_word(w) for w in [node.text, *adapter.expand(node.text)]})
            if not node.morph:
                return node.text in body
            wanted = [set(adapter.lemma_words(w)) for w in node.text.split()]
            found = [set(adapter.lemma_words(w)) for w in words]
            return any(all(x & y for x, y in zip(wanted, found[i:])) for i in range(len(found) - len(wanted) + 1))

        if holds(Q.parse(text).root):
            answer.append(chunk)
    return sorted(answer)
