"""quorumlake.plans"""
