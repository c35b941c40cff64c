"""Who may see which rows: predicates and semi joins added to a query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    user_id: str | None = None
    role: str = "anon"  # anon, member, admin, service


def visible(rows: DataFrame, members: DataFrame, who: Principal, org: str = "organization_id", active: str = "is_active") -> DataFrame:
    """Platform rows (no organization) for all; others for members of their organization;
    everything for admins and the service. Without a user, active platform rows only."""
    if who.role in ("admin", "service"):
        return rows
    if who.user_id is None:
        return rows.where(F.col(org).isNull() & F.col(active))
    own = members.where(F.col("user_id") == who.user_id).select(F.col("organization_id").alias("__org")).distinct()
    shared = rows.where(F.col(org).isNull())
    return shared.unionByName(rows.where(F.col(org).isNotNull()).join(own, F.col(org) == F.col("__org"), "left_semi"))


def organizations_of(members: DataFrame, who: Principal, admin_only: bool = False) -> DataFrame:
    own = members.where(F.col("user_id") == who.user_id)
    return (own.where("role = 'admin'") if admin_only else own).select("organization_id").distinct()


def nodes_of(nodes: DataFrame, ontologies: DataFrame, projects: DataFrame, members: DataFrame, who: Principal) -> DataFrame:
    """Nodes of the ontologies of projects whose organization the user belongs to: a chain of joins on keys alone, the
    rows themselves by a semi join."""
    own = projects.select(F.col("id").alias("project_id"), "organization_id").join(organizations_of(members, who), "organization_id")
    seen = ontologies.select(F.col("id").alias("ontology_id"), "project_id").join(own, "project_id").select("ontology_id").distinct()
    return nodes.join(seen, "ontology_id", "left_semi")


def owned(rows: DataFrame, sessions: DataFrame, who: Principal, key: str = "session_id") -> DataFrame:
    """Rows of the sessions that the user created."""
    mine = sessions.where(F.col("created_by") == who.user_id).select(F.col("id").alias(key))
    return rows.join(mine, key, "left_semi")


def ownership(wanted: DataFrame, sessions: DataFrame, who: Principal) -> DataFrame:
    """404 for sessions that are not there, 403 for those of others, 200 for own ones."""
    s = sessions.select(F.col("id").alias("session_id"), "created_by")
    code = F.when(F.col("created_by").isNull(), 404).when(F.col("created_by") != who.user_id, 403).otherwise(200)
    return wanted.join(s, "session_id", "left").withColumn("code", code).drop("created_by")


def public_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where("is_public")


def public_documents(docs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Documents of public sessions, without their source text."""
    return docs.join(public_sessions(sessions).select(F.col("id").alias("session_id")), "session_id", "left_semi").drop("source_text")


def safe_sources(sources: DataFrame) -> DataFrame:
    """Sources without what connects to them."""
    return sources.drop("connection_config")


def require(who: Principal, *roles: str) -> None:
    if who.role not in roles:
        raise PermissionError(f"{who.role} may not do this")
