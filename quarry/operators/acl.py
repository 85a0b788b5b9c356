"""Row-level access control: globs, department folders, principals, grades."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role and user tables are configuration; a side is broadcast by Spark only where its size is known to be small.


def glob_regex(glob: str) -> str:
    """A shell pattern as an anchored regular expression; a star crosses slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            inside = glob[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_match(path: Column, globs: list[str]) -> Column:
    """Whether a path fits any of the globs; ``/a/**`` becomes a prefix test, which reaches the scan."""
    out = F.lit(False)
    for g in globs:
        plain = g.rstrip("*")
        out = out | (F.startswith(path, F.lit(plain)) if plain != g and not set(plain) & set("*?[") else path.rlike(glob_regex(g)))
    return out


def normal_path(path: Column) -> Column:
    p = F.trim(path)
    return F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))


class Principal:
    """A user with roles and department, and the globs and departments of the policy."""

    def __init__(self, user: str, roles: list[str], department: str, globs: dict[str, list[str]], departments: list[str]):
        self.user, self.roles, self.department, self.globs, self.departments = user, roles, department, globs, departments

    def allowed(self, path: Column, mode: str = "read") -> Column:
        """Known department folders are decided by department alone, the rest by globs and the user's own folder."""
        p = normal_path(path)
        dept = F.regexp_extract(p, r"^/+Shared/([^/]+)", 1)
        in_dept = F.lit("admin" in self.roles) | (dept == F.lit(self.department))
        own = [f"/Private/{self.user}/**"] if mode == "read" or mode == "write" else []
        return F.when(dept.isin(*self.departments), in_dept).otherwise(glob_match(p, [*self.globs.get(mode, []), *own]))

    def decision(self, path: Column, mode: str = "read") -> Column:
        """ok, private (another's folder) or no_permission."""
        owner = F.regexp_extract(normal_path(path), r"^/+Private/([^/]+)", 1)
        return F.when(self.allowed(path, mode) | (owner == self.user), "ok").when(owner != "", "private").otherwise("no_permission")

    def sees(self, owner: Column, role: Column, department: Column) -> Column:
        return (owner == self.user) | role.isin(*self.roles) | ((department == self.department) & (department != ""))


def principal(users: DataFrame, globs: DataFrame, departments: DataFrame, user: str) -> Principal:
    """The policy of one user; these tables hold a row per user, glob and department of the configuration."""
    own = users.where(F.col("user_id") == user).collect()
    roles = sorted({r["role"] for r in own})
    rows = globs.where(F.col("role").isin(*roles)).collect() if roles else []
    by_mode: dict[str, list[str]] = {}
    for r in rows:
        by_mode.setdefault(r["mode"], []).append(r["pattern"])
    return Principal(user, roles, own[0]["department"] if own else "", by_mode, [r["department"] for r in departments.collect()])


def readable_entities(entities: DataFrame, sources: DataFrame, readable: DataFrame) -> DataFrame:
    """Entities without a source path, or with a readable one, and their readable paths.

    entities: id, ...; sources: id, source_path; readable: source_path.
    """
    seen = sources.join(readable.select("source_path").distinct(), "source_path", "left_semi")
    visible = seen.groupBy("id").agg(F.sort_array(F.collect_set("source_path")).alias("readable_paths"))
    open_ = entities.join(sources.select("id").distinct(), "id", "left_anti").withColumn("readable_paths", F.array().cast("array<string>"))
    return entities.join(visible, "id").unionByName(open_)


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def derived_roles(docs: DataFrame, globs: DataFrame) -> DataFrame:
    """The roles whose read globs fit each document's path; documents that none fits are left out.

    The globs are configuration (a row for each role and pattern), so they are compiled into one expression for each role: no join, no key.
    """
    by_role: dict[str, list[str]] = {}
    for r in globs.where("mode = 'read'").select("role", "pattern").distinct().orderBy("role", "pattern").collect():
        by_role.setdefault(r["role"], []).append(r["pattern"])
    fits = [F.when(glob_match(F.col("path"), patterns), F.lit(role)) for role, patterns in by_role.items()]
    roles = F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>")
    return docs.select("doc_id", F.array_join(roles, ",").alias("roles")).where("roles <> ''")


def resolved_permissions(users: DataFrame, templates: DataFrame, overrides: DataFrame) -> DataFrame:
    """user_id, permissions: the user's own list if there is one, else those of all roles.  templates: role, permission; overrides: user_id, permission."""
    by_role = users.join(templates, "role").groupBy("user_id").agg(F.sort_array(F.collect_set("permission")).alias("by_role"))
    own = overrides.groupBy("user_id").agg(F.sort_array(F.collect_set("permission")).alias("own"))
    joined = users.select("user_id").distinct().join(by_role, "user_id", "left").join(own, "user_id", "left")
    return joined.select("user_id", F.array_join(F.coalesce("own", "by_role", F.array().cast("array<string>")), ",").alias("permissions"))


def role_gate(required: Column, roles: Column) -> Column:
    """Whether something that needs one of the required roles is open to someone with these roles."""
    return (F.size(required) == 0) | F.arrays_overlap(required, roles)


def delete_outcomes(wanted: DataFrame, docs: DataFrame, who: Principal) -> DataFrame:
    """path, outcome: deleted, not_found or denied."""
    known = docs.select("path").distinct().withColumn("known", F.lit(True))
    return wanted.join(known, "path", "left").select("path", F.when(~who.allowed(F.col("path"), "write"), "denied").when(F.col("known"), "deleted").otherwise("not_found").alias("outcome"))
