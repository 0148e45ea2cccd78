"""Web services of knowledge bases: keyword lookup and abstracts by query. Requests are made in batches on executors, through a function
that the caller may replace, as for tests or where there is no network."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlencode

import pandas as pd
from pyspark.sql import DataFrame

TIMEOUT = 30


def get(url: str) -> str:
    """The body of a reply, as JSON is asked for."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=TIMEOUT) as reply:
        return reply.read().decode()


def lookup_url(endpoint: str, keyword: str, most: int = 10) -> str:
    return f"{endpoint}?{urlencode({'QueryString': keyword, 'MaxHits': most})}"


def abstract_url(endpoint: str, uri: str, language: str = "en") -> str:
    query = f"SELECT ?abstract WHERE {{ <{quote(uri, safe=':/#%()_,.-')}> <http://dbpedia.org/ontology/abstract> ?abstract FILTER (lang(?abstract) = '{language}') }}"
    return f"{endpoint}?{urlencode({'query': query, 'format': 'application/sparql-results+json'})}"


def _fetched(df: DataFrame, column: str, url: Callable[[str], str], read: Callable[[dict], list[str]], name: str, fetch: Callable[[str], str]) -> DataFrame:
    kind = dict(df.dtypes)[column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key in batch[column]:
                try:
                    found = read(json.loads(fetch(url(key)))) if key is not None else []
                    rows += [(key, v, None) for v in found] or [(key, None, None)]
                except (OSError, ValueError) as e:  # an unreachable service or a reply that is no JSON: told, and no other row is lost
                    rows.append((key, None, str(e)))
            yield pd.DataFrame(rows, columns=[column, name, "error"])

    return df.select(column).distinct().mapInPandas(run, f"{column} {kind}, {name} string, error string")


def looked_up(keywords: DataFrame, column: str, endpoint: str, most: int = 10, fetch: Callable[[str], str] = get) -> DataFrame:
    """(keyword, uri, error): what a lookup service finds for each distinct keyword; a null uri where it finds nothing."""
    return _fetched(keywords, column, lambda k: lookup_url(endpoint, k, most), lambda reply: [r["uri"] for r in reply.get("results", [])], "uri", fetch)


def abstracts(entities: DataFrame, column: str, endpoint: str, fetch: Callable[[str], str] = get) -> DataFrame:
    """(uri, abstract, error) by a query service."""
    return _fetched(entities, column, lambda u: abstract_url(endpoint, u), lambda reply: [b["abstract"]["value"] for b in reply["results"]["bindings"]], "abstract", fetch)
