"""Layouts that readers and writers share."""

from __future__ import annotations

INDEX_KEY = ["month", "index_type", "outlet", "scaled", "dedup_strategy"]
SEARCH_PAGE = (
    "`@odata.count` bigint, value array<struct<ResultId:string, Title:string, Date:string, "
    "Source:struct<Name:string>, Overview:string>>"
)
