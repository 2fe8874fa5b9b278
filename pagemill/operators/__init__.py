"""pagemill.operators"""
