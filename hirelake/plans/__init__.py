"""hirelake.plans"""
