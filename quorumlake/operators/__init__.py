"""quorumlake.operators"""
