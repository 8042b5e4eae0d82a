"""Declarations of cohorts and studies, and the runs that combine the operators."""
