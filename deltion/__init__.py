"""Deltion: public-procurement notice and document analytics as Spark table operators."""
