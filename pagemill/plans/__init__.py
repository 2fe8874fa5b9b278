"""pagemill.plans"""
