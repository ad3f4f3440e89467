"""Readers for the tables and files the jobs start from."""
