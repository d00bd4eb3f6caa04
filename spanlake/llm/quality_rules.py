"""Quality rules, line first: each line passes punctuation, navigation and boilerplate rules or goes;
then a document that lost too much of its text is rejected.

Defined results: a null text counts as empty; an empty text has no words, fails the base rules and
is not kept; lines without a word are neither judged nor counted; a line that breaks several rules
counts for the first of them; a share equal to its bound passes, but that of separators; repeated rows
are judged each by itself, so equal texts get equal results; a null id is carried through; a very long
text is one row of one task and is read whole; other columns of the input, whatever their names, are
not read; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_rows

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
#: Endings that a line of prose may have, and single words that separate the items of a menu.
ENDINGS = (".", "!", "?", "…", '"', "'", ")", "»", "”", ":", ";")
SEPARATORS = ("|", ">", "»", "·", "•", "/")
#: Phrases of lines that belong to a site, not to a text, by language.
BOILERPLATE = {
    "en": ("cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "subscribe to our", "sign up for", "log in to", "enable javascript", "skip to content", "share this", "follow us on", "powered by", "back to top", "click here"),
    "de": ("cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "newsletter abonnieren", "jetzt anmelden", "javascript aktivieren", "zum inhalt springen", "beitrag teilen", "folgen sie uns", "bereitgestellt von", "nach oben scrollen", "klicken sie hier"),
    "fr": ("politique de cookies", "politique de confidentialité", "conditions d'utilisation", "tous droits réservés", "abonnez-vous à", "inscrivez-vous", "activer javascript", "aller au contenu", "partager cet article", "suivez-nous sur", "propulsé par", "haut de page", "cliquez ici"),
    "es": ("política de cookies", "política de privacidad", "términos de uso", "condiciones de uso", "todos los derechos reservados", "suscríbete a", "inicia sesión", "activar javascript", "saltar al contenido", "compartir este artículo", "síguenos en", "funciona con", "volver arriba", "haz clic aquí"),
}


@dataclass(frozen=True)
class LineRules:
    """Percentages of a line's or a document's words."""

    max_symbols: int = 30
    max_exclamations: int = 30
    min_separators: int = 25
    max_lost: int = 50
    min_words: int = 50
    max_repeated: int = 50
    #: Phrases in small letters, of all languages by default, as a line's language is not known.
    boilerplate: tuple[str, ...] = tuple(x for phrases in BOILERPLATE.values() for x in phrases)


def _plain(text: str) -> str:
    return text.lower().replace("ſ", "s")


def phrases_of(text: str, rules: LineRules) -> list[str]:
    """The phrases that the text holds in any case: its lines are only asked for these."""
    low = _plain(text)
    return [p for p in rules.boilerplate if p in low]


def line_fails(line: str, words: list[bytes], rules: LineRules, phrases: list[str] | None = None) -> str:
    """The rule that the line breaks, or an empty string; phrases: those of its text, where they are known."""
    n = len(words)
    if 100 * sum(map(line.count, SYMBOLS)) > rules.max_symbols * n or 100 * line.count("!") > rules.max_exclamations * n:
        return "punctuation"
    if not words[-1].decode().endswith(ENDINGS):
        return "punctuation"
    if 100 * sum(words.count(s) for s in _SEPARATORS) >= rules.min_separators * n:
        return "navigation"
    if phrases is None:
        phrases = rules.boilerplate
    return "boilerplate" if phrases and any(map(_plain(line).__contains__, phrases)) else ""


_SEPARATORS = tuple(s.encode() for s in SEPARATORS)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of `size` words found twice or more."""
    n = len(words)
    if n <= size:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    key = seq[: n - size + 1].copy()
    for i in range(1, size):
        # ranks keep the key below 2**63 whatever the vocabulary
        key = np.unique(key, return_inverse=True)[1] * len(ids) + seq[i : n - size + 1 + i]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = count[where] > 1
    inside = np.zeros(n, bool)
    for i in range(size):
        inside[i : n - size + 1 + i] |= hit
    return int(inside.sum())


def judge(text: str, rules: LineRules) -> tuple:
    words = text.encode().split()
    n = len(words)
    seen: set[str] = set()
    dup = lost = 0
    phrases = phrases_of(text, rules)
    kept_lines, broken = [], {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line in text.split("\n"):
        if own := line.encode().split():
            dup += line in seen
            seen.add(line)
            if rule := line_fails(line, own, rules, phrases):
                broken[rule] += 1
                lost += len(own)
                continue
        kept_lines.append(line)
    repeat = repeated_words(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeated * n
    kept = not failed and 100 * lost <= rules.max_lost * n
    chars = len(text) - sum(map(text.count, SPACES))
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, failed, kept, lost, *broken.values(), "\n".join(kept_lines)


FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_words", pa.int64()), ("bad_punctuation", pa.int64()), ("bad_navigation", pa.int64()), ("bad_boilerplate", pa.int64()), ("clean_text", pa.string())]
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long, bad_punctuation long, bad_navigation long, bad_boilerplate long, clean_text string"


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: counts, verdict, lines broken by each rule and, with_text, the text that is left.

    One map over the rows, no shuffle; a task holds one Arrow batch at a time.
    """
    schema = pa.schema(FIELDS if with_text else FIELDS[:-1])

    def run(batches):
        for batch in batches:
            rows = [judge(t or "", rules) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(list(c) for c in zip(*rows))] if rows else [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, schema)], schema=schema)

    return text_rows(docs, id_col, text_col).mapInArrow(run, DDL if with_text else DDL.rpartition(",")[0])


#: The same result in DuckDB's SQL.
_WORD = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '{_WORD}') AS words FROM d),
l AS (SELECT k, u.line, u.n AS pos, regexp_extract_all(u.line, '{_WORD}') AS words
      FROM d, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n)),
l2 AS (SELECT k, line, pos, words, len(words) AS n,
       length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym,
       length(regexp_replace(line, '[^!]', '', 'g')) AS bang FROM l WHERE len(words) > 0),
l3 AS (SELECT k, n, row_number() OVER (PARTITION BY k, line ORDER BY pos) > 1 AS dup,
       100 * sym > 30 * n OR 100 * bang > 30 * n
       OR right(words[-1], 1) NOT IN ({", ".join("'" + e.replace("'", "''") + "'" for e in ENDINGS)})
       OR 100 * len(list_filter(words, lambda x: x IN ({", ".join(f"'{s}'" for s in SEPARATORS)}))) >= 25 * n
       OR regexp_matches(line, '(?i){"|".join(LineRules().boilerplate).replace("'", "''")}') AS bad FROM l2),
ls AS (SELECT k, count(*) FILTER (dup) AS n_dup, coalesce(sum(n) FILTER (bad), 0) AS lost FROM l3 GROUP BY k),
g AS (SELECT k, u.i, words[u.i] || ' ' || words[u.i + 1] || ' ' || words[u.i + 2] AS gram
      FROM w, unnest(range(1, len(words) - 1)) AS u(i)),
g2 AS (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE n > 1) GROUP BY k),
a AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      coalesce(ls.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
      coalesce(ls.lost, 0)::BIGINT AS lost
      FROM w LEFT JOIN ls USING (k) LEFT JOIN r USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * n_words AS kept
FROM a
"""
