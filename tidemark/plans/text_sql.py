"""Queries over texts and names. What patterns and name tables decide token by token has no SQL; tests hold it against cases and exact restoration."""

from __future__ import annotations

from ..operators import near_names, pseudonyms

_GUESSED = """members AS (SELECT lower(n_name) AS member, n_nationkey FROM nation), seen AS (SELECT DISTINCT CASE k WHEN 0 THEN substr(member, 2) || 'x' WHEN 1 THEN member || (c_custkey % 100) WHEN 2 THEN substr(member, 1, 2) || substr(member, 4) WHEN 3 THEN reverse(member)
  ELSE substr(member, 1, 3) || ' ' || substr(member, 4) END AS name FROM (SELECT *, c_custkey % 5 AS k FROM customer JOIN members ON c_nationkey = n_nationkey)), everyone AS (SELECT member FROM members UNION SELECT lower(r_name) FROM region),
scored AS (SELECT name, member, round(jaro_winkler_similarity(name, member), 9) AS score, jaro_winkler_similarity(name, member) AS exact FROM seen, everyone)"""

QUERIES = {
    "guessed_members": (near_names.guessed_members, "SELECT name, arg_min(member, ROW(-score, member)) AS member, max(score) AS score FROM scored WHERE exact >= 0.85 GROUP BY name", (_GUESSED,)),
    "pseudonymised_documents": (pseudonyms.pseudonymised_documents, None, ()),
    "pseudonym_keys": (pseudonyms.pseudonym_keys, None, ()),
}
