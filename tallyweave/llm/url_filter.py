"""1. URL filters: a weighted URL vocabulary behind host rules.

An Aho-Corasick automaton finds the strict and soft terms of a vocabulary in the lower-cased url;
a hit counts if neither neighbour is a letter or digit of ASCII. One strict term, or ``soft_limit``
distinct soft ones, reject a url. Rules come first: a rule (host, path, verdict) fits its host and
all subdomains if the url's path starts with the rule's, and the longest that fits decides.

The automaton and the rules are parameters, shipped with the task; ``MAX_TERMS`` bounds their
number. The urls are judged where they are read: no shuffle.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
judged by its terms (null: none, so allowed); repeated rows get the same result each; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, read_documents, small_batches

by_value(__name__)

MAX_TERMS = 1_000_000

#: Language: (strict terms, soft terms). A term that several languages share is one term; urls are ASCII, so terms are too.
VOCABULARY = {
    "en": (
        ("casino", "escort", "hentai", "nude", "porn", "porno", "viagra", "warez", "xxx"),
        ("adult", "bet", "betting", "bonus", "cheap", "cialis", "dating", "free", "gambling", "keygen", "loan", "pills", "poker", "replica", "sex", "slots"),
    ),
    "de": (
        ("huren", "nutten", "pornofilme", "sexkontakte", "spielcasino"),
        ("billig", "erotik", "gluecksspiel", "gratis", "kredit", "partnersuche", "potenzmittel", "rezeptfrei", "sofortkredit", "spielautomaten", "sportwetten", "wetten"),
    ),
    "fr": (
        ("porno", "pornographie", "putes", "salopes"),
        ("adulte", "erotique", "gratuit", "jackpot", "libertine", "paris-sportifs", "pilules", "rencontres", "roulette", "sexe", "voyance"),
    ),
    "es": (
        ("porno", "pornografia", "putas"),
        ("adultos", "apuestas", "barato", "citas", "erotico", "gratis", "pastillas", "prestamos", "ruleta", "sexo", "tragaperras"),
    ),
}
STRICT, SOFT = (tuple(sorted({x for terms in VOCABULARY.values() for x in terms[k]})) for k in (0, 1))

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_UPPER = {c: c + 32 for c in range(65, 91)}
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; both empty without ``://``."""
    m = _PARTS.search(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def fitting_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]], labels: int) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits: the longest host first, then the longest path. No rule's host has more than ``labels`` labels."""
    tail = host.rsplit(".", labels)[-labels:] if labels else []
    for k in range(len(tail)):
        end = ".".join(tail[k:])
        for start, verdict in rules.get(end, ()):
            if end and path.startswith(start):
                return end + start, verdict
    return None


def term_hits(url: str, automaton) -> tuple[int, int]:
    """Distinct strict and soft terms that stand between word boundaries."""
    low = url.translate(_UPPER)
    found: tuple[set, set] = (set(), set())
    for end, (term, strict) in automaton.iter(low):
        start = end - len(term) + 1
        if (start == 0 or low[start - 1] not in _WORD) and (end + 1 == len(low) or low[end + 1] not in _WORD):
            found[not strict].add(term)
    return len(found[0]), len(found[1])


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = 2) -> DataFrame:
    """id, host, path, rule, verdict, strict_hits, soft_hits (distinct terms) of every row."""
    if len(rules) + len(strict) + len(soft) > MAX_TERMS:
        raise ValueError(f"filter_urls: more than {MAX_TERMS} rules and terms")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host.translate(_UPPER), []).append((path, verdict))
    for v in by_host.values():
        v.sort(key=lambda x: -len(x[0]))
    labels = max((h.count(".") + 1 for h in by_host), default=0)
    terms = {**{x: False for x in soft}, **{x: True for x in strict}}

    small_batches(df.sparkSession)

    def judge(batches):
        automaton = ahocorasick.Automaton()
        for x, is_strict in terms.items():
            automaton.add_word(x, (x, is_strict))
        automaton.make_automaton()
        for b in batches:
            rows = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                n_strict, n_soft = term_hits(url, automaton) if url and terms else (0, 0)
                rule = fitting_rule(host, path, by_host, labels)
                own = "block" if n_strict or n_soft >= soft_limit else "allow"
                rows.append((host, path, rule and rule[0], rule[1] if rule else own, n_strict, n_soft))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    t = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    schema = f"id {t.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string, strict_hits int, soft_hits int"
    return t.mapInArrow(judge, schema).withColumnRenamed("id", id_col)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_documents(spark, sf_dir, "pages"))


def _sql() -> str:
    hits = lambda terms: " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){x}([^a-z0-9]|$)')::INT" for x in terms)
    fits = "\n".join(f"  WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: (-len(r[0]), -len(r[1]))))
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), h AS (
  SELECT *, {hits(STRICT)} AS strict_hits, {hits(SOFT)} AS soft_hits,
  CASE
{fits}
  END AS rule
  FROM u
)
SELECT page_id, host, path, rule,
  CASE rule {verdicts} ELSE CASE WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END END AS verdict,
  strict_hits::INT AS strict_hits, soft_hits::INT AS soft_hits
FROM h
"""


SQL = _sql()
