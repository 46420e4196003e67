"""DuckDB statements for the corpus queries that SQL can express."""

from __future__ import annotations

import re

from driftway.llm.licenses import BASE, TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)



def _template_pattern(markup: str) -> str:
    """The pattern of a template over words that each end in a blank."""
    out = []
    for token in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", markup):
        if token == "[[":
            out.append("(?:")
        elif token == "]]":
            out.append(")?")
        elif token.startswith("{{"):
            low, high = token[2:-2].split("-")
            out.append("(?:[^ ]+ ){%s,%s}" % (low, high))
        else:
            out.append(token + " ")
    return "(?:^| )" + "".join(out)


def _phrase_places(phrase: str) -> str:
    same = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
    return f"list_filter(range(1, len(w) + 1), lambda i: {same})"


_LABELS = sorted({label for label, _ in TEMPLATES})


def _accepted(label: str) -> str:
    tests = " OR ".join(f"regexp_matches(j, '{_template_pattern(m)}')" for name, m in TEMPLATES if name == label)
    return f"CASE WHEN {tests} THEN '{label}' END"


ORACLE: dict[str, str] = {
    "op1_license_scan": f"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents),
p AS (SELECT doc_id, w, array_to_string(w, ' ') || ' ' j, {", ".join(f"{_phrase_places(p)} p{k}" for k, (p, _) in enumerate(BASE))} FROM d),
f AS (SELECT *, list_sort(p0 || p1 || p2) places,
             list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(BASE))}], lambda x: x IS NOT NULL) bl,
             list_filter([{", ".join(_accepted(label) for label in _LABELS)}], lambda x: x IS NOT NULL) tl FROM p)
SELECT doc_id, len(w) n_words, len(places) n_base, places[1] - 1 first_word, places[-1] - 1 last_word,
       coalesce(array_to_string(list_sort(bl), ','), '') base_labels,
       coalesce(array_to_string(list_sort(list_distinct(bl || tl)), ','), '') labels,
       CASE WHEN len(bl) + len(tl) > 0 THEN len(tl)::DOUBLE / len(list_distinct(bl || tl)) ELSE 0.0::DOUBLE END score
FROM f""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents),
b AS (SELECT item_id, {_WORDS} w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 13) n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') g FROM s),
k AS (SELECT DISTINCT n, g FROM iw),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, (SELECT DISTINCT n FROM k)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') g FROM p),
h AS (SELECT dw.* FROM dw SEMI JOIN k USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT pos) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) ids FROM h JOIN iw USING (n, g) GROUP BY doc_id)
SELECT doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(len(ids), 0) n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_hybrid_search": f"""
WITH t AS (SELECT doc_id, unnest({_WORDS}) term FROM documents),
p AS (SELECT doc_id, term, count(*) tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT n FROM p GROUP BY doc_id),
a AS (SELECT count(*) nn, sum(n)::BIGINT ll FROM n),
f AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT w FROM (SELECT term, count(*) df FROM p GROUP BY term), a),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_WORDS}) term FROM benchmark)),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN n USING (doc_id), a GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 10""",
}
