"""All queries of the engine and their SQL."""

from tidemark.plans import activity, clusters, evaluation, mining, queries, reviews, stores, views

QUERIES = {**queries.QUERIES, **reviews.QUERIES, **mining.QUERIES, **stores.QUERIES, **activity.QUERIES, **evaluation.QUERIES, **views.QUERIES, **clusters.QUERIES}
SQL = {**queries.SQL, **reviews.SQL, **mining.SQL, **stores.SQL, **activity.SQL, **evaluation.SQL, **views.SQL, **clusters.SQL}
