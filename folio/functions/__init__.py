"""Catalogue entity resolution on Spark. Part: functions."""
