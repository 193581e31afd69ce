"""Metadata records of bibliography entries from public scholarly services, fetched where the entries are.

A service is a name, the address that it is asked at for an entry's fields, and a reader of its answer. The download is a
parameter, so that recorded answers can stand in for the network."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: addresses, parameters and answer fields of the services
TIMEOUT = 8.0
CROSSREF, OPENALEX = "https://api.crossref.org/works", "https://api.openalex.org/works"
SCHOLAR, ARXIV = "https://api.semanticscholar.org/graph/v1/paper/search/match", "https://export.arxiv.org/api/query"
SCHOLAR_FIELDS = "title,year,authors,venue,externalIds,url"
ATOM = "{http://www.w3.org/2005/Atom}"
ALIASES = {"s2": "semanticscholar"}

RECORD = "struct<title:string,year:string,authors:array<string>,doi:string,venue:string,url:string>"
SCHEMA = f"key string, provider_ord int, record_ord int, provider string, record {RECORD}, error string"
KIND = pa.struct([("title", pa.string()), ("year", pa.string()), ("authors", pa.list_(pa.string())), ("doi", pa.string()), ("venue", pa.string()), ("url", pa.string())])


@dataclass(frozen=True)
class Service:
    name: str
    ask: Callable[[dict[str, str]], str]
    read: Callable[[str], list[dict]]


def record(title=None, year=None, authors=(), doi=None, venue=None, url=None) -> dict:
    return {"title": title or "", "year": str(year) if year else None, "authors": [a for a in authors if a], "doi": doi, "venue": venue, "url": url}


def head(values):
    """The first of a list, or the value itself."""
    return (values[0] if values else None) if isinstance(values, list) else values


def _address(base: str, **asked) -> str:
    return f"{base}?{urllib.parse.urlencode({k.replace('__', '.').replace('_', '-'): v for k, v in asked.items()})}"


def _ask_crossref(fields: dict[str, str]) -> str:
    if fields.get("doi"):
        return f"{CROSSREF}/{urllib.parse.quote(fields['doi'], safe='')}"
    return _address(CROSSREF, query__title=fields.get("title", ""), rows=3)


def _read_crossref(body: str) -> list[dict]:
    message = json.loads(body).get("message", {})
    out = []
    for x in message["items"] if "items" in message else [message] if message else []:
        dated = next((x[k] for k in ("published-print", "published-online", "issued") if x.get(k)), {})
        year = head(head(dated.get("date-parts") or []) or [])
        names = [" ".join(p for p in (a.get("given"), a.get("family")) if p) for a in x.get("author", [])]
        out.append(record(head(x.get("title")), year, names, x.get("DOI"), head(x.get("container-title"))))
    return out


def _read_openalex(body: str) -> list[dict]:
    venue = lambda x: ((x.get("primary_location") or {}).get("source") or {}).get("display_name")
    names = lambda x: [(a.get("author") or {}).get("display_name") for a in x.get("authorships", [])]
    return [record(x.get("title"), x.get("publication_year"), names(x), x.get("doi"), venue(x), x.get("id")) for x in json.loads(body).get("results", [])]


def _read_scholar(body: str) -> list[dict]:
    answer = json.loads(body)
    rows = answer.get("data", [answer]) if isinstance(answer, dict) else []  # one paper may come without a list
    return [record(x["title"], x.get("year"), [a.get("name") for a in x.get("authors") or []], (x.get("externalIds") or {}).get("DOI"), x.get("venue"), x.get("url")) for x in rows if x.get("title")]


def _read_arxiv(body: str) -> list[dict]:
    said = lambda x, tag: x.findtext(ATOM + tag, default="")
    return [record(" ".join(said(x, "title").split()), said(x, "published")[:4], [said(a, "name") for a in x.findall(ATOM + "author")], None, "arXiv", x.findtext(ATOM + "id")) for x in ElementTree.fromstring(body).findall(ATOM + "entry")]


SERVICES = {
    s.name: s
    for s in (
        Service("crossref", _ask_crossref, _read_crossref),
        Service("openalex", lambda f: _address(OPENALEX, search=f.get("title", ""), per_page=3), _read_openalex),
        Service("semanticscholar", lambda f: f"{SCHOLAR}?{urllib.parse.urlencode({'query': f.get('title', ''), 'fields': SCHOLAR_FIELDS})}", _read_scholar),
        Service("arxiv", lambda f: f"{ARXIV}?{urllib.parse.urlencode({'search_query': 'ti:' + chr(34) + f.get('title', '') + chr(34), 'max_results': 3})}", _read_arxiv),
    )
}


def services(names: list[str] | None = None) -> list[Service]:
    """The services of those names in order, all of them by default; an unknown name is an error."""
    out = []
    for name in names or list(SERVICES):
        key = name.strip().lower()
        key = ALIASES.get(key, key)
        if key not in SERVICES:
            raise ValueError(f"Unknown metadata provider: {name}")
        out.append(SERVICES[key])
    return out


def download(address: str) -> str:
    with urllib.request.urlopen(address, timeout=TIMEOUT) as answer:
        return answer.read().decode("utf-8")


def fetched_records(entries: DataFrame, names: list[str] | None = None, fetch: Callable[[str], str] = download) -> DataFrame:
    """What the services have on each entry (key, fields), for verify_metadata: a row for each record.

    A service that fails gives a row with its error and one that has nothing a row without record, so that calls can be
    counted. Entries with neither title nor DOI are not asked for."""
    chosen = services(names)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for key, fields in zip(batch.column("key").to_pylist(), batch.column("fields").to_pylist(), strict=True):
                fields = dict(fields or [])
                if not fields.get("title") and not fields.get("doi"):
                    continue
                for i, service in enumerate(chosen):
                    try:
                        found = service.read(fetch(service.ask(fields)))
                    except Exception as e:  # whatever a service does, the others count
                        rows.append((key, i, 0, service.name, None, str(e)))
                        continue
                    rows += [(key, i, j, service.name, x, None) for j, x in enumerate(found)] or [(key, i, 0, service.name, None, None)]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), KIND, pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["key", "provider_ord", "record_ord", "provider", "record", "error"])

    return entries.select("key", "fields").mapInArrow(run, SCHEMA)
