"""Relational operators over keyed records."""
