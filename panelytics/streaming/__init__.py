"""Months arrive as whole files; new files are taken up once."""
