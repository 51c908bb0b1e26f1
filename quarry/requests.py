"""Search requests on the driver: validation, cursors, configuration and plug-ins."""

from __future__ import annotations

import base64
import binascii
import copy
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from quarry.functions.constants import SCORING

LIST_FILTERS = ("solution_category", "risk_type", "solution_type", "countries", "region")


class RequestError(ValueError):
    pass


@dataclass
class SearchRequest:
    query: str = ""
    filters: dict[str, Any] = field(default_factory=dict)
    parameters: dict[str, Any] = field(default_factory=dict)


def encode_cursor(query_id: str, page: int) -> str:
    return base64.b64encode(json.dumps({"query_id": query_id, "page": page}).encode()).decode()


def decode_cursor(cursor: str) -> dict[str, Any]:
    try:
        found = json.loads(base64.b64decode(cursor, validate=True))
    except (binascii.Error, ValueError) as reason:
        raise RequestError("the cursor cannot be read") from reason
    if not isinstance(found, dict) or not {"query_id", "page"} <= found.keys():
        raise RequestError("the cursor lacks query_id or page")
    return found


def parse_request(body: Any) -> SearchRequest:
    """A request from its decoded JSON; max_results is 1 to 100, filters are lists
    of strings but ppp_involvement, a boolean."""
    if not isinstance(body, dict):
        raise RequestError("a request is an object")
    query, filters, parameters = body.get("query", ""), body.get("filters", {}), body.get("parameters", {})
    if not isinstance(query, str) or not isinstance(filters, dict) or not isinstance(parameters, dict):
        raise RequestError("query is a string; filters and parameters are objects")
    most = parameters.get("max_results", 20)
    if isinstance(most, bool) or not isinstance(most, int) or not 1 <= most <= 100:
        raise RequestError("max_results is from 1 to 100")
    if parameters.get("cursor"):
        decode_cursor(parameters["cursor"])
    for name in LIST_FILTERS:
        value = filters.get(name)
        if value is not None and not (isinstance(value, list) and all(isinstance(v, str) for v in value)):
            raise RequestError(f"{name} is a list of strings")
    if not isinstance(filters.get("ppp_involvement", False), bool):
        raise RequestError("ppp_involvement is true or false")
    return SearchRequest(query, filters, {"max_results": most} | parameters)


def merged(base: dict[str, Any], updates: dict[str, Any]) -> dict[str, Any]:
    """base with updates laid over it, nested objects key by key; base is not changed."""
    found = copy.deepcopy(base)
    for key, value in updates.items():
        nested = isinstance(value, dict) and isinstance(found.get(key), dict)
        found[key] = merged(found[key], value) if nested else copy.deepcopy(value)
    return found


def scoring(updates: dict[str, Any] | None = None) -> dict[str, Any]:
    return merged(SCORING, updates or {})


def without_nulls(value: Any) -> Any:
    """Nested objects without keys whose value is null."""
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    return [without_nulls(v) for v in value] if isinstance(value, list) else value


class Plugins:
    """Named functions of one kind: embedding models, annotators, uri minters, handlers."""

    def __init__(self, kind: str):
        self.kind = kind
        self._known: dict[str, Callable] = {}

    def add(self, name: str) -> Callable[[Callable], Callable]:
        def keep(function: Callable) -> Callable:
            self._known[name] = function
            return function

        return keep

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise KeyError(f"no {self.kind} named {name}; there are {sorted(self._known)}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


EMBEDDINGS, ANNOTATORS, MINTERS, HANDLERS, ACCUMULATORS, EXTRACTORS = map(
    Plugins, ("embedding model", "annotator", "uri minter", "handler", "accumulator", "extractor")
)
