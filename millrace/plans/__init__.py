"""Registered queries. Importing the package fills the registry."""

from millrace.plans import audits, context, evals, files, finance, guard, ingest, messaging, retrieval, texts  # noqa: F401
