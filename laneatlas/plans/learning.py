"""Queries of feature vectors and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from laneatlas.functions.shapes import log_hu
from laneatlas.operators import learning as L
from laneatlas.sources.adapters import SQL, table, view


def _features(spark, d):
    return view(spark, d, "features")


def standardize(spark, d):
    z = L.standardized(_features(spark, d)).select("vec_id", F.posexplode("f").alias("i", "z"))
    return z.select("vec_id", "i", F.round("z", 6).alias("z"))


def class_weights(spark, d):
    return L.class_weights(_features(spark, d)).select("label", "n", F.round("weight", 6).alias("weight"))


def samples_per_label(spark, d):
    return _features(spark, d).groupBy("label").agg(F.count("*").alias("n"))


def finite_filter(spark, d):
    odd = F.transform("f", lambda x, i: F.when((i == 0) & (F.col("vec_id") % 7 == 0), F.lit(float("nan"))).when((i == 1) & (F.col("vec_id") % 11 == 0), F.lit(float("inf"))).otherwise(x))
    return L.finite_only(_features(spark, d).withColumn("f", odd)).select("vec_id", "label")


def argmax_class(spark, d):
    return _features(spark, d).select("vec_id", L.argmax(F.col("f")).alias("cls"))


def prediction_accuracy(spark, d):
    t = _features(spark, d).select("label", (L.argmax(F.col("f")) % 2).alias("p"))
    return t.agg(F.round(F.avg((F.col("p") == F.col("label") % 2).cast("double")), 6).alias("accuracy"))


def log_moments(spark, d):
    """Each number as a Hu moment, on a logarithmic scale."""
    u = _features(spark, d).select("vec_id", F.posexplode("f").alias("i", "x"))
    return u.select("vec_id", "i", F.round(log_hu(F.when(F.col("vec_id") % 13 == 0, 0.0).otherwise(F.col("x"))), 6).alias("v"))


def train_rf_predict(spark, d):
    p = L.prepared(_features(spark, d))
    return L.forest_predicted(p).select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"))


def feature_importance(spark, d):
    ranked = L.forest_importances(L.prepared(_features(spark, d)))
    return spark.createDataFrame([(n, float(v)) for n, v in ranked], "feature string, importance double")


_F = SQL["features"]
_U = f"(select vec_id, label, generate_subscripts(f,1)-1 as i, unnest(f) as x from {_F})"
QUERIES = {
    "standardize": (standardize, f"with u as {_U}, s as (select i, avg(x) as m, stddev_pop(x) as d from u group by i) select vec_id, u.i::int as i, round((x-m)/(case when d=0 then 1 else d end),6) as z from u join s on s.i=u.i"),
    "class_weights": (class_weights, f"with c as (select label, count(*) as n from {_F} group by 1) select label, n, round((select sum(n) from c)::double/((select count(*) from c)*n),6) as weight from c"),
    "samples_per_label": (samples_per_label, f"select label, count(*) as n from {_F} group by 1"),
    "finite_filter": (finite_filter, f"select vec_id, label from {_F} where vec_id%7<>0 and vec_id%11<>0"),
    "argmax_class": (argmax_class, f"select vec_id, (list_position(f, list_max(f))-1)::int as cls from {_F}"),
    "prediction_accuracy": (prediction_accuracy, f"select round(avg(case when (list_position(f, list_max(f))-1)%2 = label%2 then 1.0::double else 0 end),6) as accuracy from {_F}"),
    "log_moments": (log_moments, f"select vec_id, i::int as i, round(case when vec_id%13=0 or x=0 then 0 else least(20.0::double, greatest(-20.0::double, -sign(x)*log10(abs(x)+1e-10::double))) end, 6) as v from {_U}"),
    "train_rf_predict": (train_rf_predict, None),
    "feature_importance": (feature_importance, None),
}
