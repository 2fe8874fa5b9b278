"""pagemill.streaming"""
