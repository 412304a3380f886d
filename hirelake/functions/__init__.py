"""hirelake.functions"""
