"""Users and access rules: P12, A9, X1-X4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.exprs import role_label

_MATRIX_SCHEMA = T.StructType([
    T.StructField("role", T.StringType(), False),
    T.StructField("resource", T.StringType(), False),
    T.StructField("actions", T.ArrayType(T.StringType()), False),
])


def role_labels(users: DataFrame, default: str = C.ROLE_LABEL_DEFAULT) -> DataFrame:
    """Display label of each user's role (default for an unknown role)."""
    return users.select("id", "username", "role", role_label(F.col("role"), default).alias("libelle"))


def users_by_role(users: DataFrame) -> DataFrame:
    """Users and active users per role."""
    return users.groupBy("role").agg(F.count(F.lit(1)).alias("nombre_utilisateurs"),
                                     F.count_if(F.col("actif")).alias("actifs"))


def permission_rows(spark: SparkSession, matrix: dict | None = None) -> DataFrame:
    """The role x resource x action matrix as rows (fixed, at most a few
    dozen rows: its size is bounded by the matrix, not by the data)."""
    m = matrix or C.PERMISSIONS
    rows = [(r, res, list(acts)) for r, d in m.items() for res, acts in d.items()]
    return (spark.createDataFrame(rows, _MATRIX_SCHEMA)
            .select("role", "resource", F.explode("actions").alias("action")))


def permission_matrix(users: DataFrame, matrix: dict | None = None) -> DataFrame:
    """X1 over the data: each permission with the number of active accounts
    that hold it through their role."""
    perms = permission_rows(users.sparkSession, matrix)
    per_role = users.where(F.col("actif")).groupBy("role").agg(F.count(F.lit(1)).alias("comptes"))
    return (perms.join(per_role, "role", "left")
            .select("role", "resource", "action",
                    F.coalesce(F.col("comptes"), F.lit(0)).alias("comptes")))


def authorize_requests(requests: DataFrame, matrix: dict | None = None) -> DataFrame:
    """allowed = (role, resource, action) is in the matrix.

    The matrix is a fixed table of a few dozen rows, so broadcasting it is
    bounded; the request log is never shuffled for this join.
    """
    perms = permission_rows(requests.sparkSession, matrix).select(
        F.col("role").alias("_r"), F.col("resource").alias("_res"),
        F.col("action").alias("_act"), F.lit(True).alias("_ok"))
    cond = ((requests.role == perms._r) & (requests.resource == perms._res)
            & (requests.action == perms._act))
    j = requests.join(F.broadcast(perms), cond, "left")
    return j.select(*requests.columns, F.coalesce(F.col("_ok"), F.lit(False)).alias("allowed"))


def denied_summary(authorized: DataFrame) -> DataFrame:
    """Denied requests per role and action (role 'anonyme' when unknown)."""
    return (authorized.where(~F.col("allowed"))
            .groupBy(F.coalesce(F.col("role"), F.lit("anonyme")).alias("role"), "action")
            .agg(F.count(F.lit(1)).alias("refus")))


def ownership_violations(requests: DataFrame, users: DataFrame) -> DataFrame:
    """A ``responsable`` may only create jobs in their own name.

    ``requests`` has req_id, req_user_id and the raw ``responsable`` text;
    the comparison is on the raw text, as the rule does.
    """
    u = users.select(F.col("id").alias("_uid"), F.col("username").alias("req_username"),
                     F.col("role").alias("req_role"))
    j = requests.join(u, requests.req_user_id == u._uid, "left")
    bad = (F.col("req_role") == "responsable") & ~F.col("responsable").eqNullSafe(F.col("req_username"))
    return j.where(bad).select("req_id", "req_user_id", "req_username", "responsable")
