"""pagemill.functions"""
