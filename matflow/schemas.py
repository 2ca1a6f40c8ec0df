"""StructTypes of the four domain tables (ids widened to long, no password)."""

from pyspark.sql import types as T

STOCK = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("materiel", T.StringType(), False),
    T.StructField("quantite", T.IntegerType(), False),
    T.StructField("date_ajout", T.DateType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), True),
    T.StructField("updated_by", T.StringType(), True),
])

PRODUCTION = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("produit", T.StringType(), False),
    T.StructField("quantite", T.IntegerType(), False),
    T.StructField("responsable", T.StringType(), False),
    T.StructField("date_prod", T.DateType(), False),
    T.StructField("cout", T.DecimalType(12, 2), False),
    T.StructField("statut", T.StringType(), False),
    T.StructField("stock_id", T.LongType(), True),
    T.StructField("qte_consommee", T.IntegerType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), True),
    T.StructField("updated_by", T.StringType(), True),
])

AUDIT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("utilisateur", T.StringType(), False),
    T.StructField("role_utilisateur", T.StringType(), True),
    T.StructField("action", T.StringType(), False),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("record_id", T.LongType(), False),
    T.StructField("ancienne_valeur", T.StringType(), True),
    T.StructField("nouvelle_valeur", T.StringType(), True),
    T.StructField("details", T.StringType(), True),
    T.StructField("ip_address", T.StringType(), True),
    T.StructField("user_agent", T.StringType(), True),
    T.StructField("timestamp", T.TimestampNTZType(), False),
])

USERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("username", T.StringType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("tentatives", T.IntegerType(), False),
    T.StructField("bloque_jusqu", T.LongType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("last_login", T.TimestampNTZType(), True),
    T.StructField("actif", T.BooleanType(), False),
])

BY_NAME = {"stock": STOCK, "production": PRODUCTION, "audit": AUDIT, "users": USERS}


def conform(df, schema: T.StructType):
    """Select and cast ``df`` to ``schema`` (column order and types)."""
    from pyspark.sql import functions as F
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
